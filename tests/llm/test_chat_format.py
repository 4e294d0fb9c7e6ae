import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from mediatrends.llm.chat_format import PART, escape, example, format_chats, formatted_digests, read_back, unescape
from pyspark.sql import functions as F
from tests.conftest import SF

SCHEMA = "conv_id long, turn long, role string, text string"
HARD = ["\\### Assistant: </turn> ok", "<turn:assistant>x</turn>\n", "&lt;&amp;lt;", "<image:1>", "", None, "a\r\n\u2028é😀", "&", "<", ">", "</turn>\n" * 3]


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="&<>ltgamp;/turn:\n \\x", max_size=20), min_size=1, max_size=30))
def test_escape_is_reversible(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", escape(F.col("t")).alias("e"), unescape(escape(F.col("t"))).alias("u")).collect():
        assert r.u == r.t and "<" not in r.e and ">" not in r.e


def test_round_trip(spark):
    rows = [(c, i, ["user", "assistant", "a<b>"][i % 3], HARD[(i + c) % len(HARD)]) for c in range(4) for i in range(9)]
    got = formatted_digests(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    for r in got:
        own = [(role, text or "") for c, _, role, text in rows if c == r.conv_id]
        learned = "".join(t for role, t in own if role == "assistant")
        assert r.n_turns == len(own) and r.loss_chars == len(learned)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in own).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()


def test_the_added_conversation(spark):
    (row,) = formatted_digests(example(spark)).collect()
    text = r"\### Assistant: </turn> ok"
    assert (row.conv_id, row.n_turns, row.loss_chars) == (-7, 2, len(text))
    assert row.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


def test_given_conversations(spark):
    given_ = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = sorted(given_.collect(), key=lambda r: (r.conv_id, r.turn))
    for r in formatted_digests(given_).collect():
        own = [x for x in rows if x.conv_id == r.conv_id]
        assert r.turns_sha256 == hashlib.sha256("".join(f"{x.role}\n{x.text}\n" for x in own).encode()).hexdigest()


def test_attachments_are_numbered_and_counted(spark):
    part = lambda kind, **more: {k: more.get(k) for k in ("text", "ref", "width", "height", "seconds", "pages")} | {"type": kind}
    rows = [
        (1, 0, "user", [part("text", text="see <this> "), part("image", ref="a.png", width=56, height=57), part("audio", ref="b.wav", seconds=1.5)]),
        (1, 1, "assistant", [part("text", text="ok")]),
        (1, 2, "user", [part("document", ref="c.pdf", pages=3), part("image", ref=None)]),
        (2, 0, "user", None),
    ]
    messages = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{PART}>")
    one, two = format_chats(messages).orderBy("conv_id").collect()
    assert one.formatted == "<turn:user>see &lt;this&gt; <image:1><audio:2></turn>\n<turn:assistant>ok</turn>\n<turn:user><document:3><image:4></turn>\n"
    assert [(a.kind, a.ref, a.tokens) for a in one.attachments] == [("image", "a.png", 6), ("audio", "b.wav", 38), ("document", "c.pdf", 1536), ("image", None, 0)]
    assert one.learned == [False, True, False] and two.formatted == "<turn:user></turn>\n" and two.attachments == []
    read = read_back(format_chats(messages)).orderBy("conv_id").first()
    assert [t.role for t in read.turns] == ["user", "assistant", "user"] and read.loss == ["ok"]


def test_odd_tables(spark):
    rows = [(None, None, None, None), (None, None, None, None), (3, 1, "assistant", "x" * 300_000), (3, 1, "assistant", "a")]
    got = {r.conv_id: r for r in formatted_digests(spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", before int, parts int")).collect()}
    assert got[None].n_turns == 2 and got[3].loss_chars == 300_001
    assert got[3].loss_sha256 == hashlib.sha256(("a" + "x" * 300_000).encode()).hexdigest()
    assert formatted_digests(spark.createDataFrame([], SCHEMA)).collect() == []


def test_no_python_runs(spark):
    plan = read_back(format_chats(spark.range(1).selectExpr("id conv_id", "id turn", "'user' role", f"CAST(array() AS array<{PART}>) parts")))
    assert not any(word in plan._jdf.queryExecution().toString() for word in ("Python", "Pandas", "Arrow"))
