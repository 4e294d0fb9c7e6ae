import pytest
from pyspark.sql import functions as F

from mediatrends.llm.url_filter import features, filter_urls, host_of, path_of, rule_of
from tests.conftest import SF

SCHEMA = "page_id long, url string"
CASES = [
    (None, "", "", None), ("", "", "", None), ("no scheme/x", "", "", None), ("http://A.NET", "a.net", "", None), ("http://a.net/", "a.net", "/", "net/"),
    ("x://Example.NET/en/?a#b", "example.net", "/en/", "example.net/en/"), ("x://sub.example.net/en/1", "sub.example.net", "/en/1", "example.net/en/"),
    ("x://example.net/en", "example.net", "/en", "net/"), ("x://xexample.net/en/", "xexample.net", "/en/", "net/"), ("x://org/fr/x?y", "org", "/fr/x", "org/fr/"),
    ("x://a.org/FR/", "a.org", "/FR/", None), ("x://example.com/de/1#f", "example.com", "/de/1", "example.com/de/"), ("x://É.net?q=/", "É.net", "", None),
    ("a?b://c.net/d?e://f", "c.net", "/d", "net/"), ("://net/", "net", "/", "net/"), ("x://y.com#/z://n.net/", "y.com", "", None),
]


@pytest.mark.parametrize("at", range(0, len(CASES), 8))
def test_parts_and_rules(spark, at):
    cases = CASES[at : at + 8]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], SCHEMA).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    got = df.withColumn("rule", rule_of(F.col("host"), F.col("path"))).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule) for r in got] == [c[1:] for c in cases]


def test_features(spark):
    url = "https://www.a-b.com/x/12/y.html?p=1&q=2#t"
    df = spark.createDataFrame([(1, url), (2, "")], SCHEMA).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    row, blank = df.withColumns(features()).orderBy("page_id").collect()
    assert (row.url_length, row.depth, row.parameters, row["values"], row.hyphens) == (len(url), 3, 2, 2, 1)
    assert row.has_extension == row.has_fragment == row.is_secure == row.starts_www == 1
    shares = [url.count(c) / len(url) for c in set(url)]
    from math import log2

    assert abs(row.url_entropy + sum(p * log2(p) for p in shares)) < 1e-9
    assert blank.url_entropy == 0 and blank.digit_share == 0


def test_given_pages(spark):
    sf = SF.replace("0.001", "0.1")
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = filter_urls(pages).collect()
    assert len(got) == pages.count()
    for r in got:
        if r.rule:
            assert r.verdict == ("block" if r.rule in ("net/", "example.com/de/") else "allow") and r.block_probability is None
        else:
            assert r.verdict == ("block" if r.block_probability >= 0.5 else "allow")


def test_learns_held_out_rules(spark):
    """Trees fitted on the URLs of two rules find the verdict of others of the same kind, which no rule fits."""
    rows = [(i, f"http://h{i % 7}.shop.io/{'buy' if i % 2 else 'read'}/{'9' * (i % 2 * 9)}{i}") for i in range(400)]
    rows += [(1000 + i, f"http://h{i % 7}.else.io/{'sell' if i % 2 else 'tell'}/{'9' * (i % 2 * 9)}{i}") for i in range(40)]
    rules = (("block", "shop.io/buy/"), ("allow", "shop.io/read/"))
    got = filter_urls(spark.createDataFrame(rows, SCHEMA), rules=rules).filter("page_id >= 1000").collect()
    assert sum((r.verdict == "block") == bool(r.page_id % 2) for r in got) >= 36


def test_odd_tables(spark):
    df = spark.createDataFrame([(None, None, "x", 1.0), (1, "http://a.net/", "x", 1.0), (1, "http://a.net/", "x", 1.0)], SCHEMA + ", host string, label double")
    got = filter_urls(df).collect()
    assert sorted((r.page_id or 0, r.verdict, r.rule or "") for r in got) == [(0, "block", ""), (1, "block", "net/"), (1, "block", "net/")]
    assert filter_urls(df.limit(0)).collect() == []
    long_ = filter_urls(spark.createDataFrame([(1, "http://x.com/" + "ab1/" * 20_000)], SCHEMA)).collect()
    assert long_[0].verdict == "allow"


def test_no_python_runs(spark):
    df = spark.createDataFrame([(1, "http://a.b/c")], SCHEMA).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}).withColumns(features())
    plan = df._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
