"""Search history: scan rules, query volume and recency per text, event-time windows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediatrends.functions.scoring import recency_weight, timestamp, trend_score
from mediatrends.functions.text import non_blank, normalize_query


def recent(created_at: Column, as_of: Column | datetime, minutes: int | None) -> Column:
    """``created_at`` within ``minutes`` before ``as_of``; always true without minutes."""
    if minutes is None:
        return F.lit(True)
    return timestamp(created_at) >= timestamp(as_of) - F.make_dt_interval(mins=F.lit(minutes))


def newest_first() -> list[Column]:
    """History order: unknown times first, then newest first, ties by id."""
    return [F.desc_nulls_first("created_at"), F.col("id")]


def age() -> Column:
    """A BIGINT that sorts ascending like ``newest_first``, but for ties."""
    return F.coalesce(-F.unix_micros(timestamp(F.col("created_at"))), F.lit(-(1 << 63)))


def read_history(
    df: DataFrame,
    as_of: Column | datetime | None = None,
    interval_minutes: int | None = None,
    max_rows: int | None = None,
) -> DataFrame:
    """History rows with a query, optionally only recent ones and only the newest ``max_rows``.

    Rows are not sorted unless ``max_rows`` asks for the newest; order-dependent steps use
    ``newest_first`` as their key instead of the order of rows.
    """
    rows = df.filter(F.col("query").isNotNull() & non_blank("query"))
    if interval_minutes is not None:
        if as_of is None:
            raise ValueError("an interval needs as_of")
        rows = rows.filter(recent(F.col("created_at"), as_of, interval_minutes))
    rows = rows.select("id", "chat_id", F.col("query").alias("original_query"), "created_at")
    return rows if max_rows is None else rows.orderBy(*newest_first()).limit(max_rows)


def normalized(history: DataFrame) -> DataFrame:
    return history.withColumn("query", normalize_query("original_query"))


def distinct_queries(history: DataFrame) -> DataFrame:
    return history.select("query").distinct()


def query_counts(history: DataFrame, keys: list[str] = (), *more: Column) -> DataFrame:
    """Rows per text (and ``keys``), and ``first_row``, which sorts like the newest row.

    Texts whose newest rows have the same time sort by text, so that only numbers are
    aggregated and the hash aggregate needs no sort.
    """
    counted = history.groupBy(*keys, "query").agg(F.count(F.lit(1)).alias("n"), F.min(age()).alias("age"), *more)
    return counted.withColumn("first_row", F.struct("age", "query")).drop("age")


def query_activity(history: DataFrame, as_of: Column | datetime, decay_minutes: float = 5) -> DataFrame:
    """Per text: rows, summed recency, and the place of its newest row.

    Everything later works on one row per text, so a text that makes up much of the
    history is summed before any shuffle.
    """
    recency = F.sum(recency_weight(F.col("created_at"), as_of, decay_minutes))
    return query_counts(history, [], F.coalesce(recency, F.lit(0.0)).alias("recency"))


def query_scores(history: DataFrame, as_of: Column | datetime) -> DataFrame:
    """Trend score of every single text."""
    return query_activity(history, as_of).select(
        "query", F.col("n").alias("query_count"), trend_score(F.col("n"), F.col("recency")).alias("trend_score")
    )


def windowed_query_volume(
    history: DataFrame,
    width: str = "5 minutes",
    slide: str | None = None,
    watermark: str | None = "10 minutes",
    decay_minutes: float = 5,
) -> DataFrame:
    """Rows and summed recency (seen from the window end) per text and event-time window.

    Works on batch and streaming input; on a stream, rows later than the watermark are
    dropped and windows come out once they are final.
    """
    rows = history.withColumn("created_at", timestamp(F.col("created_at")))
    if watermark and rows.isStreaming:
        rows = rows.withWatermark("created_at", watermark)
    if "original_query" not in rows.columns:
        rows = rows.withColumnRenamed("query", "original_query")
    rows = rows.filter(F.col("original_query").isNotNull() & non_blank("original_query"))
    # the sums of one window share its end, so recency needs only the row's own time
    window = F.window("created_at", width, slide)
    keyed = rows.select("created_at", normalize_query("original_query").alias("query"), window.alias("window"))
    recency = recency_weight(F.col("created_at"), F.col("window.end"), decay_minutes)
    return (
        keyed.groupBy("window", "query")
        .agg(F.count(F.lit(1)).alias("query_count"), F.sum(recency).alias("recency"))
        .select("window.start", "window.end", "query", "query_count", F.round("recency", 4).alias("recency"))
    )
