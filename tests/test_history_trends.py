import math
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from mediatrends.functions.providers import embed_distinct, phrase_for_cluster, trigram_embedder
from mediatrends.functions.scoring import recency_weight
from mediatrends.operators import history as H
from mediatrends.operators import trends as T
from mediatrends.plans import jobs
from mediatrends.sources import writers

NOW = datetime(2024, 5, 1, 12, 0, tzinfo=timezone.utc)


def searches(spark, rows):
    """Rows of (id, query, minutes before NOW)."""
    data = [(i, "c1", q, None if m is None else NOW - timedelta(minutes=m)) for i, q, m in rows]
    return spark.createDataFrame(data, "id long, chat_id string, query string, created_at timestamp")


def test_read_history(spark):
    df = searches(spark, [(1, "a", 1), (2, "  ", 1), (3, None, 1), (4, "\t", 5), (5, "b", 50), (6, "c", None), (7, "d", 1)])
    assert {r["id"] for r in H.read_history(df).collect()} == {1, 4, 5, 6, 7}
    assert {r["id"] for r in H.read_history(df, NOW, 5).collect()} == {1, 4, 7}
    assert [r["id"] for r in H.read_history(df, max_rows=3).orderBy(*H.newest_first()).collect()] == [6, 1, 7]
    assert H.read_history(df).columns == ["id", "chat_id", "original_query", "created_at"]
    with pytest.raises(ValueError):
        H.read_history(df, interval_minutes=5)


def test_interval_reaches_the_scan(spark, tmp_path):
    searches(spark, [(1, "a", 1), (2, "b", 500)]).write.parquet(str(tmp_path / "h"))
    df = H.read_history(spark.read.parquet(str(tmp_path / "h")), NOW, 60)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(created_at" in plan and "ReadSchema: struct<id:bigint,chat_id:string,query:string,created_at:timestamp>" in plan
    assert df.count() == 1


def test_order_of_texts(spark):
    df = searches(spark, [(3, "a", 1), (1, "b", 1), (2, "c", None), (4, "d", 0.001), (9, "e", -5), (5, "a", 9)])
    ordered = H.query_counts(df).orderBy("first_row").collect()
    assert [(r["query"], r["n"]) for r in ordered] == [("c", 1), ("e", 1), ("d", 1), ("a", 2), ("b", 1)]
    assert [r["id"] for r in df.orderBy(*H.newest_first()).collect()] == [2, 9, 4, 1, 3, 5]


def test_recency(spark):
    df = searches(spark, [(1, "a", 0), (2, "b", 5), (3, "c", -5), (4, "d", None), (5, "e", 7.5)])
    got = [r[0] for r in df.orderBy("id").select(recency_weight(F.col("created_at"), NOW)).collect()]
    assert got[:3] == pytest.approx([1, math.exp(-1), math.e]) and got[3] is None and got[4] == pytest.approx(math.exp(-1.5))


def trend_input(spark):
    rows = [(1, "alpha", 0), (2, "alpha", 10), (3, "beta", 5), (4, "beta", 1), (5, "gamma", 2), (6, "delta", 0), (7, "delta", 0), (8, "delta", 0), (9, "noise", 0)]
    df = H.normalized(H.read_history(searches(spark, rows)))
    vectors = {"alpha": [1.0, 0.0], "beta": [1.0, 0.2], "gamma": [1.0, 0.4], "delta": [0.0, 1.0], "noise": [-1.0, 0.0]}
    cluster = {"alpha": 0, "beta": 0, "gamma": 0, "delta": 1, "noise": -1}
    labels = spark.createDataFrame([(q, cluster[q], v) for q, v in vectors.items()], "query string, cluster_id long, embedding array<double>")
    return df, labels


def test_cluster_trends(spark):
    df, labels = trend_input(spark)
    got = T.cluster_trends(df, labels, NOW).orderBy(F.desc("trend_score")).collect()
    assert [r["cluster_id"] for r in got] == [0, 1]
    recency = 1 + math.exp(-2) + math.exp(-1) + math.exp(-0.2) + math.exp(-0.4)
    assert got[0]["trend_score"] == round(0.6 * 5 + 0.4 * recency, 4) and got[1]["trend_score"] == 3.0
    assert (got[0]["query_count"], got[0]["unique_query_count"]) == (5, 3)
    # both occur twice; the newest row of "alpha" is newer
    assert [tuple(q) for q in got[0]["top_queries"]] == [("alpha", 2), ("beta", 2), ("gamma", 1)]
    assert got[0]["representative_query"] == "beta"
    assert T.cluster_trends(df, labels, NOW, min_cluster_size=4).count() == 1
    assert [r["cluster_id"] for r in T.cluster_trends(df, labels, NOW, top_n=1).collect()] == [0]


def test_ties(spark):
    rows = [(i, q, 0) for i, q in enumerate(["a"] * 3 + ["b"] * 3)]
    df = H.normalized(H.read_history(searches(spark, rows)))
    labels = spark.createDataFrame([("a", 1, [1.0, 0.0]), ("b", 0, [0.0, 1.0])], "query string, cluster_id long, embedding array<double>")
    assert [r["cluster_id"] for r in T.cluster_trends(df, labels, NOW, top_n=1).collect()] == [1]
    twins = labels.withColumn("embedding", F.array(F.lit(1.0), F.lit(1.0))).withColumn("cluster_id", F.lit(0))
    assert T.cluster_trends(df, twins, NOW).first()["representative_query"] == "a"


def test_current_trends(spark):
    old, new = NOW - timedelta(days=1), NOW
    rows = [(old, "a", None, 9.0), (new, "b two", "", 5.00004), (new, "c", "phrase HERE", 7.0), (new, "d", None, 0.5)]
    df = spark.createDataFrame(rows, "batch_timestamp timestamp, representative_query string, representative_query_generated string, trend_score double")
    got = T.current_trends(df, min_score=1.0).collect()
    assert [(r["display"], r["trend_score"]) for r in got] == [("Phrase here", 7.0), ("B two", 5.0)]
    assert T.current_trends(df, limit=1).count() == 1
    for bad in ({"limit": 0}, {"limit": 101}, {"min_score": -1}):
        with pytest.raises(ValueError):
            T.current_trends(df, **bad)


def test_embed_distinct_calls_once_per_text(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def embed(texts):
        with open(calls, "a") as f:
            f.writelines(t + "\n" for t in texts)
        assert len(texts) <= 2
        return [None if t == "skip" else [float(len(t))] for t in texts]

    df = spark.createDataFrame([("a",), ("a",), ("bb",), ("skip",), ("",), (None,), ("ccc",)], "t string")
    got = {(r["t"], None if r["embedding"] is None else tuple(r["embedding"])) for r in embed_distinct(df, "t", embed, batch_size=2).collect()}
    assert got == {("a", (1.0,)), ("bb", (2.0,)), ("skip", None), ("", None), (None, None), ("ccc", (3.0,))}
    assert sorted(open(calls).read().split()) == ["a", "bb", "ccc", "skip"]
    assert embed_distinct(df, "t", lambda: embed, how="inner", factory=True, batch_size=2).count() == 4
    with pytest.raises(Exception, match="embeddings for"):
        embed_distinct(df, "t", lambda texts: []).collect()


def test_phrases(spark):
    df = spark.sql("SELECT 'one two three four five' AS representative_query, array(named_struct('query', 'q', 'cnt', 1L)) AS top_queries")
    assert phrase_for_cluster(df).first()["representative_query_generated"] == "one two three four"
    assert phrase_for_cluster(df, lambda q, n: f"{q[0]} {n}").first()["representative_query_generated"] == "q 4"
    assert phrase_for_cluster(df, lambda q, n: 1 / 0).first()["representative_query_generated"] is None


def test_trend_job(spark, tmp_path):
    rows = [(i, q, i) for i, q in enumerate(["Red Shoes", "red shoes?", "red shoes", "blue hat", "blue hat", "Blue Hats", "zzzqqq", "  "])]
    path = str(tmp_path / "trends")
    result = jobs.trend_job(searches(spark, rows), NOW, trigram_embedder(512), eps=0.3, trends_path=path)
    got = result.trends.collect()
    assert (result.status, result.trends_identified, result.total_queries_processed) == ("success", 2, 7)
    assert [(r["representative_query"], r["query_count"], r["unique_query_count"]) for r in got] == [("red shoes", 3, 1), ("blue hat", 3, 2)]
    stored = spark.read.parquet(path)
    assert stored.count() == 2 and stored.select("batch_timestamp").distinct().count() == 1
    assert [r["display"] for r in T.current_trends(stored).collect()] == ["Red shoes", "Blue hat"]
    few = jobs.trend_job(searches(spark, rows[:2]), NOW, trigram_embedder())
    assert (few.trends_identified, few.total_queries_processed, few.message) == (0, 2, jobs.TOO_FEW_ROWS)
    apart = jobs.trend_job(searches(spark, [(1, "abc", 0), (2, "xyz", 0), (3, "123", 0)]), NOW, trigram_embedder(512))
    assert apart.message == jobs.NO_CLUSTERS
    assert jobs.trend_job(searches(spark, rows), NOW, trigram_embedder(), interval_minutes=3, max_rows=2).message == jobs.TOO_FEW_ROWS


def test_required_columns(spark):
    df = spark.sql("SELECT CAST(NULL AS STRING) AS representative_query, 1.0D AS trend_score, 3 AS query_count, 1 AS unique_query_count, NULL AS top_queries, TIMESTAMP'2024-01-01' AS created_at")
    with pytest.raises(Exception, match="representative_query is required"):
        writers.trend_rows(df, NOW).collect()


def test_full_history(spark, tmp_path):
    from mediatrends.sources import readers

    rows = [(i, q, i) for i, q in enumerate(["red shoes", "blue hat", "Red shoes", "zzzqqq", "blue hat!", "red shoes"])]
    out = str(tmp_path)
    found = jobs.full_history_clusters(searches(spark, rows), trigram_embedder(512), sample_rows=2, out_path=out)
    got = {r["row_id"]: (r["query"], r["cluster_id"]) for r in found.rows.collect()}
    assert got == {0: ("red shoes", 0), 1: ("blue hat", 1), 2: ("red shoes", 0), 3: ("zzzqqq", None), 4: ("blue hat", 1), 5: ("red shoes", 0)}
    assert {(r["cluster_id"], r["row_id"]) for r in found.samples.collect()} == {(0, 0), (0, 2), (1, 1), (1, 4)}
    read = readers.read_cluster_json(spark, f"{out}/clusters", n_rows=5)
    assert {tuple(r) for r in read.collect()} == {(0, 0), (0, 2), (1, 1), (1, 4)}
    vectors = spark.read.json(f"{out}/embeddings")
    assert vectors.count() == 6 and vectors.select("query").distinct().count() == 3 and spark.read.json(f"{out}/queries").count() == 6


def test_windows(spark):
    df = searches(spark, [(1, "A", 0), (2, "a ", 2), (3, "a", 6), (4, " ", 1), (5, "b", 1)])
    got = {(r["start"].minute, r["query"]): (r["query_count"], r["recency"]) for r in H.windowed_query_volume(df).collect()}
    assert got == {(0, "a"): (1, round(math.exp(-1), 4)), (55, "a"): (1, round(math.exp(-0.4), 4)), (55, "b"): (1, round(math.exp(-0.2), 4)), (50, "a"): (1, round(math.exp(-0.2), 4))}
    sliding = H.windowed_query_volume(df, "10 minutes", "5 minutes").agg(F.sum("query_count")).first()[0]
    assert sliding == 8
