"""Trends: clusters of queries scored by volume and recency, and the latest batch of them."""

from __future__ import annotations

from datetime import datetime

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediatrends.functions.scoring import (
    RECENCY_DECAY_MINUTES,
    RECENCY_WEIGHT,
    VOLUME_WEIGHT,
    round4,
    timestamp,
    trend_score,
)
from mediatrends.functions.text import display_phrase
from mediatrends.functions.vectors import rowwise
from mediatrends.operators.history import query_activity
from mediatrends.session import materialize, scratch_scope

# Smallest cluster that counts, trends kept per batch, texts listed per trend.
MIN_CLUSTER_SIZE = 3
TOP_N_TRENDS = 20
TOP_QUERIES = 5


def centroids(points: DataFrame, keys: list[str], vector_col: str = "vector", weight_col: str = "weight") -> DataFrame:
    """Weighted mean vector per key, summed on both sides of the shuffle."""
    mean = Summarizer.mean(array_to_vector(F.col(vector_col).cast("array<double>")), F.col(weight_col))
    return points.groupBy(*keys).agg(vector_to_array(mean).alias("centroid"))


def top_n_per_group(df: DataFrame, keys: list[str], order_by: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows per key, with their 1-based ``place``."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by))
    return df.withColumn("place", place).filter(F.col("place") <= n)


def top_queries(activity: DataFrame, n: int = TOP_QUERIES, keys: list[str] = ("cluster_id",)) -> DataFrame:
    """The most frequent texts per cluster, ties by newest, as one bounded list."""
    keys = list(keys)
    best = top_n_per_group(activity, keys, [F.desc("n"), F.asc("first_row")], n)
    item = F.struct("place", "query", F.col("n").alias("cnt"))
    return best.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(item)), lambda q: q.dropFields("place")).alias("top_queries")
    )


def medoid_queries(members: DataFrame, keys: list[str] = ("cluster_id",)) -> DataFrame:
    """Per cluster the text nearest by cosine to the mean vector, ties by newest row."""
    keys = list(keys)
    means = centroids(members.withColumn("weight", F.col("n").cast("double")), keys, "embedding")
    distance = F.round(rowwise("cosine")(F.col("embedding"), F.col("centroid")), 12)
    scored = members.join(means, keys).select(*keys, "query", "first_row", distance.alias("distance"))
    return scored.groupBy(*keys).agg(
        F.min_by("query", F.struct("distance", "first_row")).alias("representative_query")
    )


def score_clusters(
    activity: DataFrame,
    labels: DataFrame,
    as_of: Column | datetime,
    min_cluster_size: int = MIN_CLUSTER_SIZE,
    volume_weight: float = VOLUME_WEIGHT,
    recency_weight: float = RECENCY_WEIGHT,
    top_n: int = TOP_N_TRENDS,
) -> DataFrame:
    """``cluster_trends`` for a history that is already summed per text (``query_activity``)."""
    with scratch_scope(activity.sparkSession) as scope:
        members = activity.join(labels.filter("cluster_id >= 0"), "query")
        per_cluster = members.groupBy("cluster_id").agg(
            F.sum("n").alias("query_count"),
            F.sum("recency").alias("recency"),
            F.count(F.lit(1)).alias("unique_query_count"),
            F.min("first_row").alias("first_row"),
        )
        score = trend_score(F.col("query_count"), F.col("recency"), volume_weight, recency_weight)
        ranked = (
            per_cluster.filter(F.col("query_count") >= min_cluster_size)
            .withColumn("trend_score", score)
            .orderBy(F.desc("trend_score"), F.asc("first_row"))
            .limit(top_n)
        )
        ranked = materialize(ranked, "ranked")
        # the kept clusters are at most top_n rows
        kept = members.join(F.broadcast(ranked.select("cluster_id")), "cluster_id")
        trends = (
            ranked.join(top_queries(kept.drop("embedding")), "cluster_id")
            .join(medoid_queries(kept), "cluster_id")
            .select(
                "cluster_id", "representative_query", "trend_score", "query_count", "unique_query_count", "top_queries",
                timestamp(as_of).alias("created_at"),
            )
        )
        return scope.keep(materialize(trends, "trends"))


def cluster_trends(
    history: DataFrame,
    labels: DataFrame,
    as_of: Column | datetime,
    decay_minutes: float = RECENCY_DECAY_MINUTES,
    **options,
) -> DataFrame:
    """Score the clusters of a history and keep the best.

    ``history`` has ``id``, ``query`` (normalised) and ``created_at``; ``labels`` gives
    ``query``, ``cluster_id`` and ``embedding`` of each distinct text. Clusters under
    ``min_cluster_size`` rows and noise are left out; equal scores keep the order in which
    clusters first occur in the history. Other options are those of ``score_clusters``.
    """
    with scratch_scope(history.sparkSession) as scope:
        activity = materialize(query_activity(history, as_of, decay_minutes), "activity")
        return scope.keep(score_clusters(activity, labels, as_of, **options))


def max_batch(trends: DataFrame) -> DataFrame:
    return trends.agg(F.max("batch_timestamp").alias("batch_timestamp"))


def current_trends(trends: DataFrame, limit: int = TOP_N_TRENDS, min_score: float = 0.0) -> DataFrame:
    """Trends of the newest batch with at least ``min_score``, best first, with a phrase."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    if min_score < 0:
        raise ValueError("min_score must not be negative")
    if "batch_date" in trends.columns:  # the table's partitions: only the newest day is read
        newest = trends.agg(F.max("batch_date").alias("d")).first()["d"]
        trends = trends.filter(F.col("batch_date") == F.lit(newest))
    latest = trends.filter(F.col("batch_timestamp") == max_batch(trends).scalar())
    ties = [c for c in ("cluster_id", "representative_query", "id") if c in trends.columns]
    return (
        latest.filter(F.col("trend_score") >= min_score)
        .orderBy(F.desc("trend_score"), *ties)
        .limit(limit)
        .withColumn("trend_score", round4(F.col("trend_score")))
        .withColumn("display", display_phrase("representative_query_generated", "representative_query"))
    )
