import corpus_pipeline
from mediatrends.llm.decontaminate import UNITS
from mediatrends.llm.quality import quality_rules
from tests.conftest import SF
from tests.llm import plain

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "personal_data", "mixing"]


def test_equals_plain_version(spark):
    """All stages but the limits of the quality rules, which have tests of their own, in plain Python."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in quality_rules(docs).filter("kept").collect()}
    rows = sorted((r for r in docs.collect() if r.doc_id in kept), key=lambda r: r.doc_id)
    assert not any(plain.counts(r.text)[-1] for r in rows)
    first = plain.first_similar([(r.doc_id, r.text) for r in rows])
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [r for r in rows if r.doc_id in first and not any(plain.leaks(r.text, i, set(UNITS)) for i in items)]
    masked = {r.doc_id: plain.mask(r.text) for r in rows}
    copies = plain.mix([(r.doc_id, masked[r.doc_id], r.source) for r in rows])
    want = {i: (masked[i], c, t) for i, (c, t) in copies.items() if c}
    got = corpus_pipeline.run(spark, SF)
    assert got.columns[:5] == COLUMNS
    got = {r.doc_id: r for r in got.collect()}
    assert got.keys() == want.keys()
    for i, (text, c, target) in want.items():
        assert got[i].text == text and got[i].mix_copies == c and abs(got[i].mix_target - target) < 1e-6


def test_stages_return_the_columns_of_documents(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0)]
    rows += [(i, " ".join(f"w{i * k % 997}" for k in range(70)), "en", None, 1) for i in range(2, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for given in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            given = stage(spark, given, SF)
            assert given.columns[:5] == COLUMNS and (name == "mixing" or len(given.columns) == 5)
        assert given.count() in (0, 7)
