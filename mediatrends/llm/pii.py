"""Personal data: fixed patterns as seeds, and bootstrapped contexts that find further identifiers.

Everything here is DataFrame functions. A context is the word before a token that holds a digit. Contexts
and tokens form a graph; a context is trusted by the share of all its occurrences in the corpus that stand
before tokens already trusted, and a token by its best context. Both are scored in turns, beginning with
the tokens that the fixed patterns match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediatrends.llm.common import job, join_unique, materialize, type_of, unused

# The patterns of the contract. A match can only begin where a run of its first characters begins, or where
# the match before ended; saying so, and never giving back what a loop took, finds the same matches in time
# linear in the text.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
FOUND = "id"  # kind of the spans that contexts add

TOKEN = r"(?<![^\x20\x09-\x0D])[^0-9\x20\x09-\x0D]*+[0-9][^\x20\x09-\x0D]*+"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_EDGES = ".,;:!?\"'()[]{}<>"

ROUNDS = 3
SUPPORT = 3  # different trusted tokens that a context needs
CONFIDENCE = 0.5
_BLOCK = 64

SPAN = "struct<kind:string,start:int,stop:int>"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, place: Column) -> Column:
        digit = F.ascii(F.substr(digits, F.length(digits) + 1 - place, F.lit(1))) - 48
        doubled = digit * 2
        return total + F.when(place % 2 == 1, digit).otherwise(F.when(doubled > 9, doubled - 9).otherwise(doubled))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    n = F.length(_digits(match))
    if kind == "card":
        return F.when(n.between(13, 19), _luhn(_digits(match))).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _pieces(text: Column, pattern: str, matches: Column) -> Column:
    """The text before each match."""
    return F.when(F.size(matches) > 0, F.slice(F.split(text, pattern, -1), 1, F.size(matches)))


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, b: a + b)


def _starts(step: Column) -> Column:
    """Running sums of an array of lengths, the first 0. In blocks, so that long arrays stay cheap."""

    def running(steps: Column, before: Column) -> Column:
        block = lambda i: F.floor(i / _BLOCK).cast("int")
        return F.transform(steps, lambda _, i: before[block(i)] + _sum(F.slice(steps, block(i) * _BLOCK + 1, i % _BLOCK)))

    def sums(steps: Column) -> Column:
        last = F.ceil(F.size(steps) / _BLOCK).cast("int") - 1
        return F.transform(F.sequence(F.lit(0), last), lambda b: _sum(F.slice(steps, b * _BLOCK + 1, F.lit(_BLOCK))))

    def before(blocks: Column) -> Column:
        return F.transform(blocks, lambda _, b: _sum(F.slice(blocks, F.lit(1), b)))

    return _let(step, lambda steps: _let(sums(steps), lambda blocks: _let(before(blocks), lambda base: running(steps, base))))


def _scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """By row: the matches of each kind with the length of the text before each, and the tokens with their contexts."""
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = base.withColumns({f"m_{k}": F.regexp_extract_all("text", F.lit(p), 0) for k, p in (KINDS | {"token": TOKEN}).items()})
    found = found.withColumn("before", _pieces(F.col("text"), TOKEN, F.col("m_token")))
    gaps = {k: F.transform(_pieces(F.col("text"), p, F.col(f"m_{k}")), F.length) for k, p in KINDS.items()}
    left = F.transform("before", lambda p: F.substring_index(F.rtrim(F.translate(F.lower(p), "\t\n\x0b\x0c\r", "     ")), " ", -1))
    columns = [c for k, g in gaps.items() for c in (F.col(f"m_{k}"), g.alias(f"g_{k}"))]
    return found.select(
        F.monotonically_increasing_id().alias("row"), "id", F.xxhash64("text").alias("text_key"), *columns,
        "m_token", F.transform("before", F.length).alias("g_token"), left.alias("left"),
    )


def _base_spans(kind: str) -> Column:
    def span(z: Column) -> Column:
        stop = z[f"b_{kind}"] + z[f"s_{kind}"]
        return F.struct(F.lit(kind).alias("kind"), (stop - F.length(z[f"m_{kind}"])).alias("start"), stop.alias("stop"))

    each = F.filter(F.arrays_zip(f"b_{kind}", f"s_{kind}", f"m_{kind}"), lambda z: _valid(kind, z[f"m_{kind}"]))
    return F.transform(each, span)


def _placed(scanned: DataFrame) -> DataFrame:
    """``spans`` of the fixed patterns, by kind and start, and ``tokens`` with place, context and whether a span meets them."""
    kinds = [*KINDS, "token"]
    lengths = {f"s_{k}": F.coalesce(F.zip_with(f"g_{k}", F.transform(f"m_{k}", F.length), lambda g, m: g + m), F.array().cast("array<int>")) for k in kinds}
    # where the text before a match and the match itself end
    ends = scanned.withColumns(lengths)
    placed = ends.withColumns({f"b_{k}": F.when(F.size(f"s_{k}") > 0, _starts(F.col(f"s_{k}"))).otherwise(F.array().cast("array<int>")) for k in kinds})
    spans = [_base_spans(kind) for kind in KINDS]
    tokens = F.transform(
        F.arrays_zip("b_token", "s_token", "m_token", "left"),
        lambda z: F.struct(
            z["left"].alias("left"), z["m_token"].alias("token"),
            (z["b_token"] + z["s_token"] - F.length(z["m_token"])).alias("start"), (z["b_token"] + z["s_token"]).alias("stop"),
        ),
    )
    return placed.select("row", "id", "text_key", F.concat(*spans).alias("spans"), tokens.alias("tokens"))


def _occurrences(placed: DataFrame) -> DataFrame:
    """One row per token that has a context: ``row``, ``left``, ``token``, its place, ``core`` (the token without the marks at
    its edges) and ``seed``, whether a span meets it."""
    meets = lambda t: F.exists("spans", lambda s: (s["start"] < t["stop"]) & (s["stop"] > t["start"]))
    marked = F.transform("tokens", lambda t: t.withField("seed", meets(t)))
    each = placed.filter(F.size("tokens") > 0).select("row", F.explode(marked).alias("t")).select("row", "t.*")
    core = F.rtrim(F.ltrim(F.col("token"), F.lit(_EDGES)), F.lit(_EDGES))
    return each.filter(F.col("left") != "").withColumn("core", core)


def trusted_contexts(docs: DataFrame, occurrences: DataFrame, text_col: str = "text") -> DataFrame:
    """``left`` and ``confidence`` of the contexts that are trusted in the end.

    A context's confidence is the sum of the scores of the tokens after it over all its occurrences in the corpus,
    before whatever word. It needs ``SUPPORT`` different tokens whose score reaches ``CONFIDENCE``.
    """
    edges = occurrences.groupBy("left", "core").agg(F.count(F.lit(1)).alias("n"), F.bool_or("seed").alias("seed"))
    edges = materialize(edges, "edges")
    enough = edges.groupBy("left").agg(F.count(F.lit(1)).alias("n_tokens"), F.sum("n").alias("n_edges")).filter(F.col("n_tokens") >= SUPPORT)
    enough = materialize(enough, "contexts")
    words = docs.select(F.explode(F.split(F.lower(F.col(text_col)), r"[\x20\x09-\x0D]+")).alias("left"))
    # Spark broadcasts the contexts if they are small, and otherwise sends the words by their hash
    totals = words.join(enough.select("left"), "left", "left_semi").groupBy("left").agg(F.count(F.lit(1)).alias("n_all"))
    totals = materialize(totals, "context_totals")
    graph = materialize(edges.join(totals, "left"), "graph")
    seed = F.when(F.col("seed"), 1.0).otherwise(0.0)
    scores = materialize(graph.groupBy("core").agg(F.max(seed).alias("score"), F.count(F.lit(1)).alias("n_left")), "scores")
    for turn in range(ROUNDS):
        scored = join_unique(graph, scores, "core", F.col("n_left"))
        sums = scored.groupBy("left", "n_all").agg(
            F.sum(F.col("n") * F.col("score")).alias("mass"), F.count_if(F.col("score") >= CONFIDENCE).alias("trusted")
        )
        confident = sums.filter(F.col("trusted") >= SUPPORT).select("left", F.least(F.col("mass") / F.col("n_all"), F.lit(1.0)).alias("confidence"))
        confident = materialize(confident.filter(F.col("confidence") >= CONFIDENCE), "confident")
        if turn + 1 < ROUNDS:
            best = graph.join(confident, "left").groupBy("core").agg(F.max("confidence").alias("best"))
            raised = F.greatest("score", F.coalesce("best", F.lit(0.0)))
            scores = materialize(scores.join(best, "core", "left").select("core", raised.alias("score"), "n_left"), "scores")
    return confident


def _trimmed(spans: DataFrame) -> DataFrame:
    """Spans of the cores of tokens."""
    start = F.col("start") + F.length("token") - F.length(F.ltrim(F.col("token"), F.lit(_EDGES)))
    return spans.select("row", F.struct(F.lit(FOUND).alias("kind"), start.alias("start"), (start + F.length("core")).alias("stop")).alias("span"))


def _spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``text_key``, ``base`` and ``added`` (arrays of spans) of every row."""
    placed = materialize(_placed(materialize(_scanned(docs, id_col, text_col), "scanned")), "placed")
    occurrences = materialize(_occurrences(placed), "occurrences")
    contexts = trusted_contexts(docs, occurrences, text_col)
    new = occurrences.filter("NOT seed").join(contexts.select("left"), "left", "left_semi")
    added = _trimmed(new).groupBy("row").agg(F.sort_array(F.collect_list("span")).alias("added"))
    none = F.array().cast(f"array<{SPAN}>")
    joined = placed.join(added, "row", "left")
    return joined.select("id", "text_key", F.col("spans").alias("base"), F.coalesce("added", none).alias("added"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of personal data in every row of ``docs``.

    ``id_col``, ``n_email``, ``n_ip``, ``n_card``, ``n_phone`` (spans of the fixed patterns), ``base_sha256`` (digest of these
    spans), ``spans`` (all spans as ``kind:start:end``; those found by context have kind ``id`` and come last) and
    ``n_added``. Places are in code points. A null text is empty. Repeated rows get the same spans. Tokens that meet a span
    of the fixed patterns are never added. An empty table gives an empty one.
    """
    with job(docs.sparkSession) as scope:
        found = _spans(docs, id_col, text_col)
        kinds = F.transform("base", lambda s: s["kind"])
        counts = [F.size(F.filter(kinds, F.lit(k).__eq__)).cast("bigint").alias(f"n_{k}") for k in KINDS]
        result = found.select(
            F.col("id").alias(id_col), *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
            _listed(F.concat("base", "added")).alias("spans"), F.size("added").alias("n_added"),
        )
        return scope.keep(materialize(result, "pii"))


def mask_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span of personal data replaced by its kind in brackets; other columns are unchanged.

    Of spans that overlap, the first is named and the whole covered stretch is replaced. The spans are found, the
    texts not yet computed.
    """
    with job(docs.sparkSession) as scope:
        found = _spans(docs, id_col, text_col).withColumn("all", F.concat("base", "added")).filter(F.size("all") > 0)
        ordered = F.array_sort("all", lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(b["stop"] - a["stop"]))
        own_id, own_key, own_spans = unused(docs, "masked_id", "masked_key", "masked_spans")
        found = found.select(F.col("id").alias(own_id), F.col("text_key").alias(own_key), ordered.alias(own_spans)).dropDuplicates([own_id, own_key])
        found = scope.keep(materialize(found, "masks"))
    text = F.col(text_col)

    def add(done: Column, span: Column) -> Column:
        fresh = span["start"] >= done["at"]
        before = F.substr(text, done["at"] + 1, span["start"] - done["at"])
        return F.struct(
            F.greatest(done["at"], span["stop"]).alias("at"),
            F.when(fresh, F.concat(done["out"], before, F.lit("["), F.upper(span["kind"]), F.lit("]"))).otherwise(done["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    masked = F.aggregate(own_spans, start, add, lambda done: F.concat(done["out"], F.substr(text, done["at"] + 1, F.length(text))))
    same = F.col(id_col).eqNullSafe(F.col(own_id)) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col(own_key))
    rows = docs.join(found, same, "left").withColumn(text_col, F.when(F.col(own_spans).isNull(), text).otherwise(masked))
    return rows.select(*docs.columns)
