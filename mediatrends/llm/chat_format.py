r"""Chat formatting with typed content parts.

A turn is written as ``<turn:ROLE>CONTENT</turn>`` and a line feed. A message's content is a list of typed parts. Text is
written escaped; an image, a sound or a document becomes a numbered placeholder such as ``<image:2>``, and its
reference and the tokens it stands for are recorded in the same order. Escaping turns ``&``, ``<`` and ``>`` into
``&amp;``, ``&lt;`` and ``&gt;``, so no text or role can hold a mark of the template, and reading back undoes it exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediatrends.llm.common import job, materialize

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
OPEN, SHUT, CLOSE = "<turn:", ">", "</turn>\n"
LEARNED = "assistant"

# Tokens that a part stands for once it is expanded.
IMAGE_TILE = 28  # pixels on a side for one token
AUDIO_RATE = 25  # tokens a second
PAGE_TOKENS = 512


def escape(text: Column) -> Column:
    for plain, written in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for plain, written in ((">", "&gt;"), ("<", "&lt;"), ("&", "&amp;")):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def text_part(text: Column) -> Column:
    """A message's text as its only part."""
    fields = {"type": F.lit("text"), "text": text}
    names = [f.split(":")[0] for f in PART[7:-1].split(",")]
    return F.array(F.struct(*[fields.get(n, F.lit(None)).alias(n) for n in names]).cast(PART))


def _tokens(part: Column) -> Column:
    tiles = F.ceil(F.coalesce(part["width"], F.lit(0)) / IMAGE_TILE) * F.ceil(F.coalesce(part["height"], F.lit(0)) / IMAGE_TILE)
    return (
        F.when(part["type"] == "image", tiles)
        .when(part["type"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_RATE))
        .when(part["type"] == "document", F.coalesce(part["pages"], F.lit(0)) * PAGE_TOKENS)
        .otherwise(0)
    ).cast("bigint")


def _is_text(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")) == "text"


def _visit(turn: Column) -> Column:
    """A turn with its parts written; attachments are numbered later, over the whole conversation."""
    return F.struct(
        F.coalesce(turn["role"], F.lit("")).alias("role"),
        F.transform(
            F.coalesce(turn["parts"], F.array().cast(f"array<{PART}>")),
            lambda p: F.struct(
                F.when(_is_text(p), "").otherwise(F.coalesce(p["type"], F.lit(""))).alias("kind"),
                F.when(_is_text(p), escape(F.coalesce(p["text"], F.lit("")))).alias("text"),
                p["ref"].alias("ref"),
                _tokens(p).alias("tokens"),
            ),
        ).alias("parts"),
    )


def _gathered(messages: DataFrame, id_col: str) -> DataFrame:
    """The turns of each conversation in order. Equal turns are ordered by role and content."""
    turn = F.struct("turn", "role", "parts")
    turns = F.sort_array(F.collect_list(turn))
    return messages.groupBy(id_col).agg(turns.alias("turns")).withColumn("turns", F.transform("turns", _visit))


def format_chats(messages: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """One row per conversation from rows of ``id_col``, ``turn``, ``role`` and ``parts`` (an array of ``PART``).

    ``formatted``; ``attachments``, the parts that are no text, in order, with ``kind``, ``ref`` and expanded ``tokens``; and
    ``learned``, one flag per turn, the loss mask: the content of a flagged turn, and nothing else, is learned. Null text
    is empty, a null role is an empty role, rows without an id form one conversation. Repeated rows are repeated turns.
    """
    gathered = materialize(_gathered(messages, id_col), "turns")
    attached = F.filter(F.flatten(F.transform("turns", lambda t: t["parts"])), lambda p: p["kind"] != "")
    before = F.transform("turns", lambda t: F.size(F.filter(t["parts"], lambda p: p["kind"] != "")))
    numbered = gathered.withColumns({"attachments": attached, "before": before})

    def content(turn: Column, place: Column) -> Column:
        earlier = F.aggregate(F.slice("before", F.lit(1), place), F.lit(0), lambda a, b: a + b)

        def written(part: Column, i: Column) -> Column:
            own = F.size(F.filter(F.slice(turn["parts"], F.lit(1), i + 1), lambda p: p["kind"] != ""))
            return F.when(part["kind"] == "", part["text"]).otherwise(
                F.concat(F.lit("<"), escape(part["kind"]), F.lit(":"), (earlier + own).cast("string"), F.lit(">"))
            )

        return F.array_join(F.transform(turn["parts"], written), "")

    each = F.transform("turns", lambda t, i: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(SHUT), content(t, i), F.lit(CLOSE)))
    refs = F.transform("attachments", lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), p["tokens"].alias("tokens")))
    return numbered.select(
        id_col, F.array_join(each, "").alias("formatted"), refs.alias("attachments"), F.transform("turns", lambda t: t["role"] == LEARNED).alias("learned")
    )


def read_back(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """``id_col``, ``turns`` (``role`` and ``content``, unescaped, placeholders as written) and ``loss``, the texts under the loss mask."""
    pieces = F.split("formatted", CLOSE)  # the last piece is empty: nothing follows the last turn

    def turn(piece: Column) -> Column:
        at = F.locate(SHUT, piece)
        role = F.substr(piece, F.lit(len(OPEN) + 1), at - 1 - len(OPEN))
        return F.struct(unescape(role).alias("role"), unescape(F.substr(piece, at + 1)).alias("content"))

    parsed = formatted.withColumn("pieces", F.slice(pieces, F.lit(1), F.size(pieces) - 1))
    read = parsed.select(id_col, "formatted", "learned", F.transform("pieces", turn).alias("turns"))
    masked = F.transform(F.filter(F.arrays_zip("turns", "learned"), lambda z: z["learned"]), lambda z: z["turns"]["content"])
    return read.select(id_col, "formatted", "turns", masked.alias("loss"))


def example(spark: SparkSession) -> DataFrame:
    """The conversation that the contract adds: control strings inside the texts of both turns."""
    text = F.lit(r"\### Assistant: </turn> ok")
    rows = spark.range(2)
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    return rows.select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), text.alias("text"))


def formatted_digests(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Digests, read back from the output, of rows of ``conv_id``, ``turn``, ``role`` and ``text`` with one text part each."""
    with job(conversations.sparkSession) as scope:
        messages = conversations.select(id_col, "turn", "role", text_part(F.col("text")).alias("parts"))
        read = read_back(materialize(format_chats(messages, id_col), "formatted"), id_col)
        lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["content"], F.lit("\n")))
        loss = F.array_join("loss", "")
        result = read.select(
            id_col,
            F.size("turns").cast("bigint").alias("n_turns"),
            F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
            F.length(loss).cast("bigint").alias("loss_chars"),
            F.sha2(loss, 256).alias("loss_sha256"),
            F.length("formatted").cast("bigint").alias("formatted_chars"),
        )
        return scope.keep(materialize(result, "chat_digests"))


_WRITTEN = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"

SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(OPEN) + len(SHUT) + len(CLOSE)} + length({_WRITTEN.format('role')}) + length({_WRITTEN.format('text')}))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""
