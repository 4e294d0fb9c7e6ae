import random

from hypothesis import given, settings
from hypothesis import strategies as st

from mediatrends.llm.quality import METRICS, filter_quality, merged, quality_rules, sketch_quantiles, sketches, text_counts
from mediatrends.llm.quality import _counted
from tests.conftest import SF
from tests.llm import plain

SCHEMA = "doc_id long, text string, lang string, source string"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab #*|\n\t\x0b\x85 é<", max_size=60))
def test_counts(text):
    n, chars, symbols, dup, repeated, _, _ = text_counts(text)
    assert (n, chars, symbols, dup, repeated) == plain.counts(text)[:5]


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality_rules(docs).collect():
        want = plain.counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert not (r.base_failed and r.kept)


def _words(draw, n, size):
    return " ".join("".join(draw.choice("abcdefgh") for _ in range(size + draw.randint(-1, 1))) for _ in range(n))


def test_limits_follow_the_group(spark):
    draw = random.Random(1)
    rows = [(i, _words(draw, 80, 4), "en", "a") for i in range(300)] + [(1000 + i, _words(draw, 80, 12), "de", "b") for i in range(300)]
    rows += [(1, _words(draw, 80, 12), "en", "a"), (2, _words(draw, 80, 12), "de", "b"), (3, _words(draw, 80, 4), "de", "b")]
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i].kept for i in range(600))
    assert [got[i].kept for i in (600, 601, 602)] == [False, True, False]
    assert got[600].failed_metrics == "word_length"


def test_sketches_merge(spark):
    draw = random.Random(2)
    rows = [(i, _words(draw, draw.randint(60, 90), 5), draw.choice(["en", None]), draw.choice("ab")) for i in range(120)]
    counted = _counted(spark.createDataFrame(rows, SCHEMA), "doc_id", "text", "lang", "source")
    together = sketch_quantiles(merged(sketches(counted))).filter("metric = 'word_length'").first()
    values = sorted(100 * r.word_chars // r.n_words for r in counted.collect())
    for q, p in (("low", 0.1), ("mid", 0.5), ("high", 0.9)):
        exact = values[-(-int(p * 1000) * len(values) // 1000) - 1]
        assert 0 <= exact - together[q] < METRICS["word_length"]["bin"]


def test_odd_rows(spark):
    rows = [(None, None, None, None), (1, "", "en", None), (1, "", "en", None), (2, "w " * 60_000, None, "s")]
    df = spark.createDataFrame([(*r, 1, True) for r in rows], SCHEMA + ", n_words int, kept boolean")
    got = quality_rules(df).collect()
    assert len(got) == 4 and not any(r.kept for r in got)
    assert filter_quality(df).columns == df.columns and filter_quality(df).count() == 0
    assert quality_rules(df.limit(0)).collect() == []


def test_filter_keeps_what_the_rules_keep(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in quality_rules(docs).filter("kept").collect()}
    rows = filter_quality(docs).collect()
    assert {r.doc_id for r in rows} == kept and len(rows) == len(kept)


def test_keeps_good_and_drops_bad(spark):
    sf = SF.replace("0.001", "0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    judged = [(labels[r.doc_id], r.kept) for r in quality_rules(spark.read.parquet(f"{sf}/documents.parquet")).filter("n_words >= 50").collect() if r.doc_id in labels]
    good, bad = [k for q, k in judged if q], [k for q, k in judged if not q]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.1 * len(bad)
