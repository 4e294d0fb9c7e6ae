"""Per-video interaction counts and the popularity ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights of the popularity score and the default list length.
VIEW_WEIGHT = 1
LIKE_WEIGHT = 10
SHARE_WEIGHT = 20
DEFAULT_LIMIT = 15


def unresolved(reports: DataFrame) -> DataFrame:
    """Reports that are explicitly unresolved; an unknown state does not count."""
    return reports.filter(F.col("IsResolved").eqNullSafe(False))


def exclude_reported(videos: DataFrame, reports: DataFrame, null_aware: bool = True) -> DataFrame:
    """Drop videos that have an unresolved report.

    With ``null_aware`` the result is that of SQL ``NOT IN``: one unresolved report without
    a video removes every row. The plan is an equi anti join plus an uncorrelated
    existence check, so neither side has to fit in memory.
    """
    open_reports = unresolved(reports).select("VideoId")
    reported = open_reports.filter("VideoId IS NOT NULL").distinct()
    kept = videos.join(reported, videos["id"] == reported["VideoId"], "left_anti")
    if null_aware:
        kept = kept.filter(~open_reports.filter("VideoId IS NULL").exists())
        kept = kept.filter(F.col("id").isNotNull() | ~open_reports.exists())
    return kept


def _per_video(interactions: DataFrame, prefix: str) -> DataFrame:
    return interactions.groupBy(F.col("VideoId").alias("id")).agg(
        F.count(F.lit(1)).alias(f"{prefix}_rows"), F.count("Id").alias(f"{prefix}_ids")
    )


def _shares_with_posts(shares: DataFrame, posts: DataFrame) -> DataFrame:
    """Per video: share rows, share ids, posts, and sizes of the share-post outer join."""
    per_share = posts.groupBy(F.col("VideoShareId").alias("Id")).agg(
        F.count(F.lit(1)).alias("post_rows"), F.count("Id").alias("post_ids")
    )
    joined_rows = F.greatest(F.coalesce("post_rows", F.lit(0)), F.lit(1))
    return (
        shares.select("Id", "VideoId")
        .join(per_share, "Id", "left")
        .groupBy(F.col("VideoId").alias("id"))
        .agg(
            F.count("Id").alias("share_ids"),
            F.sum(joined_rows).alias("share_post_rows"),
            F.sum(F.when(F.col("Id").isNotNull(), joined_rows).otherwise(0)).alias("share_post_ids"),
            F.coalesce(F.sum("post_ids"), F.lit(0)).alias("post_ids"),
        )
    )


def video_stats(
    videos: DataFrame,
    likes: DataFrame,
    views: DataFrame,
    shares: DataFrame,
    posts: DataFrame,
    reports: DataFrame,
    mode: str = "distinct",
    null_aware: bool = True,
) -> DataFrame:
    """Like, view, share and post counts per video without an unresolved report.

    ``mode="distinct"`` counts every interaction once. ``mode="fanout"`` gives the counts of
    the four chained left joins, in which the rows of one child multiply the others; they
    follow in closed form from the per-video counts. Every child is aggregated before it
    is joined, so the joins see at most one row per video whatever the skew.
    """
    if mode not in ("distinct", "fanout"):
        raise ValueError(f"unknown mode: {mode}")
    joined = (
        exclude_reported(videos.select("id"), reports, null_aware)
        .join(_per_video(likes, "like"), "id", "left")
        .join(_per_video(views, "view"), "id", "left")
        .join(_shares_with_posts(shares, posts), "id", "left")
    )

    def count(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    def fan(name: str) -> Column:
        return F.greatest(count(name), F.lit(1))

    like, view, share, post = (count(f"{kind}_ids") for kind in ("like", "view", "share", "post"))
    if mode == "fanout":
        like = like * fan("view_rows") * fan("share_post_rows")
        view = view * fan("like_rows") * fan("share_post_rows")
        share = count("share_post_ids") * fan("like_rows") * fan("view_rows")
        post = post * fan("like_rows") * fan("view_rows")
    return joined.select(
        F.col("id").alias("video_id"),
        like.alias("like_count"),
        view.alias("view_count"),
        share.alias("share_count"),
        post.alias("post_count"),
    )


def popularity_score() -> Column:
    return (
        F.col("view_count") * VIEW_WEIGHT + F.col("like_count") * LIKE_WEIGHT + F.col("share_count") * SHARE_WEIGHT
    )


def popular_videos(stats: DataFrame, limit: int | None = DEFAULT_LIMIT) -> DataFrame:
    """The ``limit`` videos with the highest popularity score; ties go to the lower id."""
    if limit is None or limit < 0:
        limit = DEFAULT_LIMIT
    return (
        stats.select("video_id", popularity_score().alias("popularity_score"))
        .orderBy(F.desc("popularity_score"), "video_id")
        .limit(limit)
    )
