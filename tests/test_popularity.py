import random

import pytest
from pyspark.sql import functions as F

from mediatrends.operators import popularity as P
from mediatrends.plans import jobs
from mediatrends.sources import writers

LITERAL = """
SELECT v.id AS video_id, count(l.Id) AS like_count, count(w.Id) AS view_count, count(s.Id) AS share_count, count(p.Id) AS post_count
FROM t_videos v LEFT JOIN t_likes l ON l.VideoId = v.id LEFT JOIN t_views w ON w.VideoId = v.id
LEFT JOIN t_shares s ON s.VideoId = v.id LEFT JOIN t_posts p ON p.VideoShareId = s.Id
WHERE v.id NOT IN (SELECT VideoId FROM t_reports WHERE IsResolved IS FALSE) GROUP BY v.id"""


def tables(spark, seed, sizes=(25, 40, 30, 20, 6), nulls=True, null_report=False):
    rng = random.Random(seed)
    maybe = lambda v, p=0.15: None if nulls and rng.random() < p else v
    video = lambda: rng.choice([0, 0, 0, rng.randrange(12)])  # one video gets most rows
    likes, views, shares, posts, reports = sizes
    pair = "Id long, VideoId long"
    made = {
        "videos": spark.createDataFrame([(i,) for i in range(12)], "id long"),
        "likes": spark.createDataFrame([(maybe(i), maybe(video())) for i in range(likes)], pair),
        "views": spark.createDataFrame([(maybe(i), maybe(video())) for i in range(views)], pair),
        "shares": spark.createDataFrame([(maybe(i), maybe(video())) for i in range(shares)], pair),
        "posts": spark.createDataFrame([(maybe(i), maybe(rng.randrange(shares + 3))) for i in range(posts)], "Id long, VideoShareId long"),
        "reports": spark.createDataFrame([(rng.randrange(12), rng.choice([True, False, None])) for _ in range(reports)] + [(None, False)] * null_report, "VideoId long, IsResolved boolean"),
    }
    for name, df in made.items():
        df.createOrReplaceTempView(f"t_{name}")
    return made


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed, sizes", [(1, (25, 40, 30, 20, 6)), (2, (0, 10, 5, 5, 0)), (3, (5, 0, 0, 4, 3)), (4, (9, 9, 9, 0, 2))])
def test_fanout_equals_literal_joins(spark, seed, sizes):
    made = tables(spark, seed, sizes)
    assert rows(P.video_stats(**made, mode="fanout")) == rows(spark.sql(LITERAL))


def test_distinct_counts(spark):
    made = tables(spark, 5, nulls=False)
    got = {r["video_id"]: r for r in P.video_stats(**made).collect()}
    for name, column in (("likes", "like_count"), ("views", "view_count"), ("shares", "share_count")):
        want = {r["VideoId"]: r["count"] for r in made[name].groupBy("VideoId").count().collect()}
        assert all(r[column] == want.get(v, 0) for v, r in got.items())


def test_one_null_report_empties_the_result(spark):
    made = tables(spark, 6, null_report=True)
    assert rows(P.video_stats(**made)) == rows(spark.sql(LITERAL)) == []
    assert P.video_stats(**made, null_aware=False).count() > 0
    with pytest.raises(ValueError):
        P.video_stats(**made, mode="other")


def test_unknown_video_id_is_kept_only_without_reports(spark):
    videos = spark.createDataFrame([(1,), (None,)], "id long")
    reports = spark.createDataFrame([(2, False)], "VideoId long, IsResolved boolean")
    assert rows(P.exclude_reported(videos, reports)) == [(1,)]
    assert P.exclude_reported(videos, reports.limit(0)).count() == 2


def test_ranking(spark):
    df = spark.createDataFrame([(1, 1, 0, 0, 9), (2, 0, 10, 0, 0), (3, 0, 0, 1, 0), (4, 0, 1, 0, 0)], "video_id long, like_count long, view_count long, share_count long, post_count long")
    assert [tuple(r) for r in P.popular_videos(df, 3).collect()] == [(3, 20), (1, 10), (2, 10)]
    assert P.popular_videos(df, -1).count() == 4 and P.popular_videos(df, 0).count() == 0


def test_published_versions(spark, tmp_path):
    path = str(tmp_path / "stats")
    with pytest.raises(FileNotFoundError):
        writers.read_stats(spark, path)
    made = tables(spark, 7)
    stats, popular = jobs.popularity_job(made, path, limit=2)
    assert popular.count() == 2
    # a refresh may read the published version it replaces
    assert writers.overwrite_stats(stats.withColumn("like_count", F.lit(0).cast("long")), path) == 2
    assert writers.read_stats(spark, path).agg(F.sum("like_count")).first()[0] == 0


def test_no_fanout_in_the_plan(spark):
    plan = P.video_stats(**tables(spark, 8), mode="fanout")._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and "Join Cross" not in plan
