import hashlib

from mediatrends.llm.pii import find_pii, mask_pii
from tests.conftest import SF
from tests.llm import plain

SCHEMA = "doc_id long, text string"
ODD = [
    "", None, "a@b.c_d@e.f x@y", "1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.255", "+1 (988) 555-2485 +12345678 +1 2 3 4 5 6 7 8 9 0 ( ) .",
    "4041894974608795 4041-8949-7460-8795 4041 8949 7460 8795 9", "é😀 a@b.co 😀 ü.x@y-z.com.", "a" * 50_000 + "@", "1" * 60_000, "1 " * 20_000,
    "a@b.co 10.0.0.1 " * 2000, "x@@y.z a..b@c.d.e. +1.2.3.4.5.6.7.8.9", "1.2.3.4@5.6", "+" * 2000,
]


def test_base_spans(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    both = docs.unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(ODD)], SCHEMA))
    texts = {r.doc_id: r.text for r in both.collect()}
    for r in find_pii(both).collect():
        want = plain.spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(plain.listed(want).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for k, _, _ in want) for kind in plain.KINDS)
        assert r.spans.startswith(plain.listed(want))


CUES = ["contact: a1@b.com now", "contact: c2@d.org now", "contact: +1 555 123 4567 yes", "contact: (user4711), more", "login user9 the user4711"]


def test_contexts_find_identifiers_by_turns(spark):
    rows = CUES + ["contact: k77", "handle k77 x", "handle user4711", "handle m500", "handle zz81 z", "the 1999 a", "in 2000, the 5"]
    got = {r.doc_id: r.spans for r in find_pii(spark.createDataFrame(list(enumerate(rows)), SCHEMA)).collect()}
    assert got[3] == "id:10:18" and got[5] == "id:9:12"
    assert got[0] == "email:9:17"
    assert got[10] == got[11] == got[4] == ""  # never trusted: too few different tokens after these words
    rows += [f"handle k77 {i}" for i in range(4)] + ["handle user4711 b", "contact: m500"]
    got = {r.doc_id: r.spans for r in find_pii(spark.createDataFrame(list(enumerate(rows)), SCHEMA)).collect()}
    assert got[9] == "id:7:11"  # by a context that only found tokens support


def test_frequent_words_are_no_contexts(spark):
    rows = [f"the x{i}@y.com sat" for i in range(5)] + ["the cat"] * 40 + ["the b4 sat"]
    got = find_pii(spark.createDataFrame(list(enumerate(rows)), SCHEMA)).filter("n_added > 0").collect()
    assert got == []


def test_masks(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    masked = mask_pii(docs)
    assert masked.columns == docs.columns
    assert {r.doc_id: r.text for r in masked.collect()} == {i: plain.mask(t) for i, t in texts.items()}
    got = mask_pii(spark.createDataFrame(list(enumerate(CUES)), SCHEMA)).orderBy("doc_id").collect()
    assert got[3].text == "contact: ([ID]), more"


def test_odd_tables(spark):
    df = spark.createDataFrame([(None, None, 1), (1, "a@b.co", 2), (1, "a@b.co", 2)], SCHEMA + ", spans int")
    assert sorted(r.spans for r in find_pii(df).collect()) == ["", "email:0:6", "email:0:6"]
    got = mask_pii(df).collect()
    assert sorted((r.text or "", r.spans) for r in got) == [("", 1), ("[EMAIL]", 2), ("[EMAIL]", 2)]
    assert find_pii(df.limit(0)).collect() == [] and mask_pii(df.limit(0)).collect() == []


def test_no_python_runs(spark):
    from mediatrends.llm.pii import _placed, _scanned

    plan = _placed(_scanned(spark.createDataFrame([(1, "x")], SCHEMA), "doc_id", "text"))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
