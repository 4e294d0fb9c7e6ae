from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from mediatrends import session as S
from mediatrends.operators import validity


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_row_numbers_are_dense_and_ordered(spark, coalesce):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        # a third of the rows share their first sort key
        df = spark.range(9000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.xxhash64("id")).alias("k"))
        got = S.with_row_number(df, [F.desc("k"), F.col("id")]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    ordered = sorted(got, key=lambda r: (-r["k"], r["id"]))
    assert [r["row_number"] for r in ordered] == list(range(9000))


def test_row_order_increases(spark):
    got = S.with_row_order(spark.range(500).select(F.hash("id").alias("h"), "id"), [F.col("h"), F.col("id")]).collect()
    by_order = [(r["h"], r["id"]) for r in sorted(got, key=lambda r: r["row_order"])]
    assert by_order == sorted(by_order)


def test_cluster_needs_a_shared_folder():
    def fake(master, folder):
        conf = SimpleNamespace(get=lambda key, default: default)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: folder, applicationId="app-test"))

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        S.scratch_root(fake("spark://host:7077", None))
    assert S.scratch_root(fake("spark://host:7077", "hdfs://shared/x/")) == "hdfs://shared/x"
    assert S.scratch_root(fake("local[2]", None)) == S.scratch_root(fake("local[2]", None))


def test_scopes_nest(spark):
    def exists(df):
        return spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path))

    with S.scratch_scope(spark) as outer:
        with S.scratch_scope(spark) as inner:
            dropped, handed = S.materialize(spark.range(3), "a"), inner.keep(S.materialize(spark.range(4), "b"))
        assert not exists(dropped) and exists(handed)
        kept = outer.keep(S.materialize(handed, "c"))
    assert not exists(handed) and kept.count() == 4
    S.discard(kept)
    assert not exists(kept)


def test_scope_cleans_up_after_an_error(spark):
    with pytest.raises(ZeroDivisionError):
        with S.scratch_scope(spark):
            table = S.materialize(spark.range(3), "a")
            1 / 0
    with pytest.raises(Exception):
        table.collect()


def test_approximate_silhouette(spark):
    rows = [(i, [float(i % 2) * 10, i / 100], i % 2) for i in range(20)] + [(99, [5.0, 5.0], -1)]
    points = spark.createDataFrame(rows, "id long, vector array<double>, label long")
    assert validity.silhouette(points, approx=True).first()[0] > 0.99
    with pytest.raises(ValueError):
        validity.silhouette(points, ["label"], approx=True)
