"""End-to-end jobs over the operators: search, trends, popularity, ingest, tuning."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.ml.clustering import KMeansModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediatrends.functions.providers import EmbedFn, PhraseFn, embed_distinct, phrase_for_cluster
from mediatrends.functions.text import file_stem, media_type, strip_text
from mediatrends.functions.vectors import has_embedding
from mediatrends.operators import grid as tuning
from mediatrends.operators import validity
from mediatrends.operators.dbscan import DEFAULT_EPS, DEFAULT_MIN_SAMPLES, NOISE, dbscan
from mediatrends.operators.history import newest_first, normalized, query_activity, read_history
from mediatrends.operators.ivf import ivf_search
from mediatrends.operators.popularity import DEFAULT_LIMIT, popular_videos, video_stats
from mediatrends.operators.search import DEFAULT_K, attach_segments, group_segments, knn_join
from mediatrends.operators.trends import MIN_CLUSTER_SIZE, TOP_N_TRENDS, score_clusters, top_n_per_group
from mediatrends.session import materialize, scratch_scope, with_row_number
from mediatrends.schemas import VIDEO_HITS
from mediatrends.sources import readers, writers

# States and messages that jobs report.
SUCCESS, ERROR = "Success", "Error"
EMPTY_QUERY = "Query is empty or None"
EMPTY_CHAT = "chat_id is empty"
EMPTY_EMBEDDING = "Embedding is empty or None"
TOO_FEW_ROWS = "Insufficient data for clustering"
NO_CLUSTERS = "No semantic clusters found"
NO_AUDIO = "Input file missing or empty: "
UNSUITABLE = "Unsuitable file type ["


# --- search ------------------------------------------------------------------------


def query_error(query: Column, chat_id: Column) -> Column:
    """Why a search cannot run, or NULL."""
    return F.when(query.isNull() | (query == ""), EMPTY_QUERY).when(chat_id.isNull() | (chat_id == ""), EMPTY_CHAT)


def search_job(
    queries: DataFrame,
    segments: DataFrame,
    embed_fn: EmbedFn,
    created_at: datetime | None = None,
    k: int = DEFAULT_K,
    metric: str = "cosine",
    rank_by: str | None = None,
    history_path: str | None = None,
    index: KMeansModel | None = None,
    probes: int = 1,
    **embed_options,
) -> DataFrame:
    """Run searches (``query``, ``chat_id``, ``temporary_id``) against the segments.

    Every row comes back with ``status``, ``error`` and ``results``, a list of videos with
    their segments, best first; invalid searches have no results. A text is embedded and
    searched once however many rows ask for it. With ``index`` the segments need a
    ``cell`` and only the nearest ``probes`` cells are searched. Searches that found
    something are logged to ``history_path``.
    """
    checked = queries.withColumn("error", query_error(F.col("query"), F.col("chat_id").cast("string")))
    texts = checked.filter("error IS NULL").select("query").distinct()
    with scratch_scope(queries.sparkSession) as scope:
        embedded = materialize(embed_distinct(texts, "query", embed_fn, how="inner", **embed_options), "searches")
        vectors = embedded.select(F.col("query").alias("query_id"), "embedding")
        if index is None:
            hits = knn_join(vectors, segments, k, metric, rank_by)
        else:
            hits = ivf_search(vectors, segments, index, k, probes, metric, rank_by)
        videos = group_segments(attach_segments(hits, segments), ["query_id"])
        # at most k segments per text
        item = F.struct("best_rank", F.col("video_id").cast("string").alias("video_id"), "segments")
        results = videos.groupBy(F.col("query_id").alias("_query")).agg(
            F.transform(F.sort_array(F.collect_list(item)), lambda v: v.dropFields("best_rank")).alias("results")
        )
        known = embedded.select(F.col("query").alias("_query"), F.lit(True).alias("_embedded"))
        error = F.coalesce("error", F.when(F.col("_embedded").isNull(), EMPTY_EMBEDDING))
        # invalid searches have no text to join by and stay out of the joins
        valid = checked.filter("error IS NULL").withColumn("_query", F.col("query"))
        joined = valid.join(known, "_query", "left").join(results, "_query", "left")
        answered = (
            joined.unionByName(checked.filter("error IS NOT NULL"), allowMissingColumns=True)
            .withColumn("error", error)
            .withColumn("status", F.when(F.col("error").isNull(), SUCCESS).otherwise(ERROR))
            .withColumn("results", F.coalesce("results", F.array().cast(f"array<{VIDEO_HITS.simpleString()}>")))
            .withColumn("created_at", F.lit(created_at or datetime.now(timezone.utc)).cast("timestamp"))
            .drop("_query", "_embedded")
        )
        answered = scope.keep(materialize(answered, "answers"))
    if history_path is not None:
        writers.append_history(answered, history_path)
    return answered


# --- trends ------------------------------------------------------------------------


@dataclass
class TrendResult:
    """Outcome of a trend run; ``trends`` holds the ranked trends, best first."""

    trends: DataFrame | None
    trends_identified: int
    total_queries_processed: int
    status: str = "success"
    message: str | None = None
    table: DataFrame | None = None  # the written table that the trends are read from


def label_texts(embedded: DataFrame, eps: float = DEFAULT_EPS, min_samples: int = DEFAULT_MIN_SAMPLES, metric: str = "cosine") -> DataFrame:
    """``query``, ``embedding`` and ``cluster_id`` of texts with ``n``, ``first_row`` and ``embedding``.

    Clusters texts weighted by their rows, which gives the labels of clustering all rows.
    """
    with scratch_scope(embedded.sparkSession) as scope:
        labels = dbscan(
            embedded, eps, min_samples, metric, id_col="query", weight_col="n", order_by=[F.col("first_row")]
        ).select(F.col("id").alias("query"), F.col("label").alias("cluster_id"))
        return scope.keep(materialize(embedded.select("query", "embedding").join(labels, "query"), "labels"))


def label_queries(
    activity: DataFrame,
    embed_fn: EmbedFn,
    eps: float = DEFAULT_EPS,
    min_samples: int = DEFAULT_MIN_SAMPLES,
    metric: str = "cosine",
    **embed_options,
) -> DataFrame:
    """``label_texts`` of the texts of a history; those without an embedding are left out."""
    with scratch_scope(activity.sparkSession) as scope:
        texts = activity.select("query", "n", "first_row")
        embedded = materialize(embed_distinct(texts, "query", embed_fn, how="inner", **embed_options), "texts")
        return scope.keep(label_texts(embedded, eps, min_samples, metric))


def rank_activity(
    activity: DataFrame,
    as_of: datetime,
    label: Callable[[DataFrame], DataFrame],
    phrase_fn: PhraseFn | None = None,
    min_cluster_size: int = MIN_CLUSTER_SIZE,
    top_n: int = TOP_N_TRENDS,
) -> TrendResult:
    """The trends of a history that is summed per text; ``label`` gives the clusters of the texts."""
    with scratch_scope(activity.sparkSession) as scope:
        total = activity.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
        if total < min_cluster_size:
            return TrendResult(None, 0, total, message=TOO_FEW_ROWS)
        labels = label(activity)
        if labels.filter(F.col("cluster_id") != NOISE).isEmpty():
            return TrendResult(None, 0, total, message=NO_CLUSTERS)
        ranked = score_clusters(activity, labels, as_of, min_cluster_size, top_n=top_n)
        trends = scope.keep(materialize(phrase_for_cluster(ranked, phrase_fn), "trends"))
    return TrendResult(trends.orderBy(F.desc("trend_score"), "cluster_id"), trends.count(), total, table=trends)


def trend_job(
    history: DataFrame,
    as_of: datetime,
    embed_fn: EmbedFn,
    phrase_fn: PhraseFn | None = None,
    interval_minutes: int | None = None,
    max_rows: int | None = None,
    eps: float = DEFAULT_EPS,
    min_samples: int = DEFAULT_MIN_SAMPLES,
    min_cluster_size: int = MIN_CLUSTER_SIZE,
    top_n: int = TOP_N_TRENDS,
    trends_path: str | None = None,
    batch_timestamp: datetime | None = None,
    **embed_options,
) -> TrendResult:
    """Find, score, phrase and optionally persist the trends of a search history.

    The history is scanned once and summed per text; all later steps work on texts.
    """
    with scratch_scope(history.sparkSession) as scope:
        rows = normalized(read_history(history, as_of, interval_minutes, max_rows))
        activity = materialize(query_activity(rows, as_of), "activity")
        result = rank_activity(activity, as_of, lambda texts: label_queries(texts, embed_fn, eps, min_samples, **embed_options), phrase_fn, min_cluster_size, top_n)
        if result.trends is not None:
            scope.keep(result.table)
    if trends_path is not None and result.trends is not None:
        writers.persist_trends(result.table, trends_path, batch_timestamp or as_of)
    return result


@dataclass
class HistoryClusters:
    """Clusters of a whole history.

    ``rows``: row_id, query, original_query, cluster_id (NULL for noise);
    ``embeddings``: one row per distinct text; ``samples``: the newest rows per cluster.
    """

    rows: DataFrame
    embeddings: DataFrame
    samples: DataFrame


def full_history_clusters(
    history: DataFrame,
    embed_fn: EmbedFn,
    max_rows: int | None = None,
    eps: float = DEFAULT_EPS,
    min_samples: int = DEFAULT_MIN_SAMPLES,
    sample_rows: int = 5,
    out_path: str | None = None,
    **embed_options,
) -> HistoryClusters:
    """Cluster every search ever made; rows are numbered newest first.

    With ``out_path``, writes ``clusters``, ``queries`` and ``embeddings`` as JSON lines; the last has a
    line per row, so that the tuning report can place every row.
    """
    rows = normalized(read_history(history, max_rows=max_rows))
    with scratch_scope(history.sparkSession) as scope:
        numbered = with_row_number(rows, newest_first(), "row_id")
        activity = numbered.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first_row"))
        labels = scope.keep(label_queries(activity, embed_fn, eps, min_samples, **embed_options))
        cluster = F.when(F.col("cluster_id") != NOISE, F.col("cluster_id")).alias("cluster_id")
        labelled = numbered.join(labels.select("query", cluster), "query")
        labelled = scope.keep(materialize(labelled.select("row_id", "query", "original_query", "cluster_id"), "rows"))
    embeddings = labels.select("query", "embedding")
    members = labelled.filter("cluster_id IS NOT NULL").select("cluster_id", "row_id", "query")
    samples = top_n_per_group(members, ["cluster_id"], [F.col("row_id")], sample_rows)
    if out_path is not None:
        writers.export_clusters_json(members, f"{out_path}/clusters")
        labelled.select("row_id", "query", "original_query").write.mode("overwrite").json(f"{out_path}/queries")
        vectors = labelled.select("row_id", "query").join(embeddings, "query").select("row_id", "query", "embedding")
        vectors.write.mode("overwrite").json(f"{out_path}/embeddings")
    return HistoryClusters(labelled, embeddings, samples)


# --- popularity --------------------------------------------------------------------


def popularity_job(
    tables: dict[str, DataFrame],
    stats_path: str | None = None,
    limit: int = DEFAULT_LIMIT,
    mode: str = "distinct",
    null_aware: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """``(stats, popular)`` from videos, likes, views, shares, posts and reports.

    With ``stats_path`` the statistics are published as a new version and the ranking
    reads that version.
    """
    names = ("videos", "likes", "views", "shares", "posts", "reports")
    stats = video_stats(*[tables[n] for n in names], mode=mode, null_aware=null_aware)
    if stats_path is not None:
        writers.overwrite_stats(stats, stats_path)
        stats = writers.read_stats(stats.sparkSession, stats_path)
    return stats, popular_videos(stats, limit)


# --- ingest ------------------------------------------------------------------------


def transcript_segments(transcripts: DataFrame) -> DataFrame:
    """One row per transcript segment, numbered from 1 within its video."""
    placed = transcripts.select("video_id", F.posexplode("segments").alias("place", "segment"))
    return placed.select(
        "video_id",
        (F.col("place") + 1).cast("bigint").alias("segment_index"),
        F.col("segment.start").alias("segment_start_time"),
        F.col("segment.end").alias("segment_end_time"),
        strip_text(F.col("segment.text")).alias("segment_text"),
    )


def full_text(segments: Column) -> Column:
    """The stripped sentences of a transcript joined by one space."""
    return F.array_join(F.transform(segments, lambda s: strip_text(s["text"])), " ")


def transcript_text(segments: DataFrame, part_rows: int = 1000) -> DataFrame:
    """``video_text`` per video from segment rows, in segment order.

    Runs of ``part_rows`` segments are joined first, so the last step handles a few long
    texts per video and never a long list of rows.
    """

    def joined(df: DataFrame, keys: list[str], order: str, name: str, out: str) -> DataFrame:
        item = F.sort_array(F.collect_list(F.struct(order, name)))
        return df.groupBy(*keys).agg(F.array_join(F.transform(item, lambda s: s[name]), " ").alias(out))

    parts = segments.withColumn("part", F.floor(F.col("segment_index") / part_rows))
    runs = joined(parts, ["video_id", "part"], "segment_index", "segment_text", "run")
    return joined(runs, ["video_id"], "part", "run", "video_text")


def check_media(media: DataFrame) -> DataFrame:
    """Add ``video_id``, ``media_type`` and ``error`` (NULL for a usable video file)."""
    kind = media_type("path")
    missing = F.concat(F.lit(NO_AUDIO), F.col("path"))
    unsuitable = F.concat(F.lit(UNSUITABLE), F.coalesce(F.col("media_type"), F.lit("None")), F.lit("]"))
    return (
        media.withColumn("video_id", file_stem("path"))
        .withColumn("media_type", kind)
        .withColumn(
            "error",
            F.when(F.coalesce(F.col("size"), F.lit(0)) <= 0, missing).when(
                ~F.col("media_type").eqNullSafe("video"), unsuitable
            ),
        )
    )


@dataclass
class TranscriptTables:
    videos: DataFrame
    segments: DataFrame
    rejected: DataFrame


def build_transcript_tables(
    media: DataFrame,
    transcripts: DataFrame,
    embed_fn: EmbedFn,
    tenant_id: str,
    video_url: str | None = None,
    metadata: dict | None = None,
    title_prefix: str = "video_",
    out_path: str | None = None,
    **embed_options,
) -> TranscriptTables:
    """Video and segment rows with embeddings for the media files (``path``, ``size``).

    Titles number the accepted files in path order. Segments and embeddings are matched by
    text, so a segment without an embedding is left out and shifts no other. Files that are
    empty, are no video or have no transcript are in ``rejected``.
    """
    with scratch_scope(media.sparkSession) as scope:
        checked = materialize(check_media(media), "media")
        accepted = with_row_number(checked.filter("error IS NULL"), [F.col("path")], "place")
        title = F.concat(F.lit(title_prefix), (F.col("place") + 1).cast("string"))
        named = materialize(accepted.select("video_id", "path", title.alias("title")), "accepted")
        spoken = named.drop("path").join(transcripts, "video_id")
        if metadata is None:
            meta = F.lit("null")
        else:
            meta = F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in metadata.items()]))
        text = spoken.select(
            "video_id", F.lit(tenant_id).alias("tenant_id"), "title", F.lit(video_url).cast("string").alias("video_url"),
            meta.alias("video_metadata"), full_text(F.col("segments")).alias("video_text"),
        )
        # results are written once, so the model is not asked again whenever one is read
        videos = embed_distinct(text, "video_text", embed_fn, "text_embedding", **embed_options)
        videos = scope.keep(materialize(videos.withColumnRenamed("video_id", "id"), "videos"))
        parts = transcript_segments(spoken).withColumn("tenant_id", F.lit(tenant_id))
        segments = embed_distinct(parts, "segment_text", embed_fn, "segment_embedding", how="inner", **embed_options)
        segments = scope.keep(materialize(segments, "segments"))
        silent = named.join(transcripts.select("video_id"), "video_id", "left_anti").select("path")
        without = checked.filter("error IS NULL").join(silent, "path", "left_semi").withColumn("error", F.concat(F.lit(NO_AUDIO), F.col("path")))
        rejected = scope.keep(materialize(checked.filter("error IS NOT NULL").unionByName(without), "rejected"))
    if out_path is not None:
        writers.write_transcript_parquet(videos, segments, out_path)
    return TranscriptTables(videos, segments, rejected)


def ingest_parquet(
    spark: SparkSession,
    paths: str | list[str],
    videos_path: str,
    segments_path: str,
    dim: int | None = None,
    dedupe: bool = False,
) -> None:
    """Append video and segment files to their tables; a duplicate video stops the run first."""
    paths = readers.check_parquet_paths(spark, paths)
    videos, segments = readers.route_parquet(spark, paths, dim)
    if not videos.isEmpty():
        writers.append_videos(videos, videos_path, dim)
    if not segments.isEmpty():
        writers.append_segments(segments, segments_path, dedupe, dim)


# --- tuning ------------------------------------------------------------------------


def tuning_report(
    points: DataFrame,
    members: DataFrame,
    eps_list: list[float] = tuning.GRID_EPS,
    min_samples_list: list[int] = tuning.GRID_MIN_SAMPLES,
    metric: str = "l2",
) -> dict[str, DataFrame]:
    """Judge a clustering and search for better parameters.

    ``points`` has ``row_id`` and ``embedding``, ``members`` has ``cluster_id`` and ``row_id``;
    unlisted points are noise.
    """
    rows = materialize(points.filter(has_embedding("embedding")).select("row_id", "embedding"), "points")
    labels = materialize(validity.label_rows(rows, members), "labels")
    placed = rows.join(labels, "row_id").select(
        F.col("row_id").alias("id"), F.col("embedding").alias("vector"), "label"
    )
    grid = materialize(tuning.dbscan_grid(rows, eps_list, min_samples_list, metric, id_col="row_id"), "report")
    report = {
        "diagnostics": validity.cluster_diagnostics(labels),
        "size_histogram": validity.size_histogram(labels),
        "largest_clusters": validity.largest_clusters(labels),
        "silhouette": validity.silhouette(placed),
        "davies_bouldin": validity.davies_bouldin(placed),
        "calinski_harabasz": validity.calinski_harabasz(placed),
        "grid": grid,
        "best_silhouette": tuning.best_configs(grid, "silhouette"),
        "best_davies_bouldin": tuning.best_configs(grid, "davies_bouldin"),
    }
    for name in ("silhouette", "davies_bouldin", "num_clusters", "noise_pct"):
        report[f"pivot_{name}"] = tuning.metric_pivot(grid, name, sorted(eps_list))
    return report
