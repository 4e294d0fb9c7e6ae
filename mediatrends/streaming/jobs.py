"""Structured Streaming forms of the scheduled jobs.

Every micro-batch writes to folders of its own, named by its id and overwritten on a
replay, so a restarted query neither loses nor repeats rows. What a query has to remember
lies in keyed tables (``sources.buckets``) of which a batch touches its own buckets only.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructType, TimestampType

from mediatrends import schemas
from mediatrends.functions.providers import EmbedFn, PhraseFn, embed_distinct
from mediatrends.functions.scoring import RECENCY_DECAY_MINUTES, recency_weight, timestamp
from mediatrends.functions.vectors import unnest_vector
from mediatrends.operators.dbscan import DEFAULT_EPS, DEFAULT_MIN_SAMPLES
from mediatrends.operators.history import age, normalized, read_history, windowed_query_volume
from mediatrends.operators.popularity import exclude_reported
from mediatrends.operators.trends import MIN_CLUSTER_SIZE, TOP_N_TRENDS
from mediatrends.plans.jobs import label_texts, rank_activity
from mediatrends.session import materialize, scratch_scope
from mediatrends.sources.buckets import BUCKETS, BucketTable
from mediatrends.sources.files import SEGMENT_FILES, VIDEO_FILES, read_files, store_of
from mediatrends.sources.readers import is_segment_file
from mediatrends.sources.writers import DuplicateVideoError, conform, existing, overwrite_stats, persist_trends

INTERACTION_KINDS = ("like", "view", "share", "post")

HISTORY_INPUT = StructType([schemas.HISTORY[c] for c in ("id", "chat_id", "query", "created_at")])
SEEN = StructType().add("kind", StringType()).add("Id", LongType())
SHARES = StructType().add("share_id", LongType()).add("known", BooleanType()).add("video_id", LongType()).add("posts", LongType())
TEXT_STATE = (
    StructType().add("query", StringType()).add("n", LongType()).add("mass", DoubleType()).add("newest", TimestampType()).add("age", LongType())
)
VIDEO_KEYS = StructType().add("id", StringType())
SEGMENT_KEYS = StructType().add("video_id", StringType()).add("segment_index", LongType())
TEXT_VECTORS = StructType().add("query", StringType()).add("embedding", schemas.VECTOR)


def _start(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None) -> StreamingQuery:
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def _write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def text_state(history: DataFrame, decay_minutes: float = RECENCY_DECAY_MINUTES) -> DataFrame:
    """What trends need of a normalised history, one row per text, whatever the moment they are asked for.

    ``n`` rows, the ``newest`` known time, ``age`` (which sorts like the newest row), and ``mass``: the summed recency as
    seen from the text's own newest row. Seen from a later moment it is the mass times the recency of that row.
    """
    newest = history.groupBy("query").agg(F.max("created_at").alias("newest"), F.count(F.lit(1)).alias("n"), F.min(age()).alias("age"))
    weighed = history.join(newest.select("query", "newest"), "query")
    mass = F.coalesce(F.sum(recency_weight(F.col("created_at"), F.col("newest"), decay_minutes)), F.lit(0.0))
    return weighed.groupBy("query").agg(mass.alias("mass")).join(newest, "query").select(*TEXT_STATE.names)


def merged_state(stored: DataFrame, new: DataFrame, decay_minutes: float = RECENCY_DECAY_MINUTES) -> DataFrame:
    """Two states of the same texts as one; each has a text at most once."""
    old = stored.select("query", *[F.col(c).alias(f"old_{c}") for c in TEXT_STATE.names[1:]])
    both = old.join(new, "query", "full")
    newest = F.greatest("old_newest", "newest")  # the other one if one is null

    def seen(mass: str, time: str) -> Column:
        return F.coalesce(F.col(mass) * recency_weight(F.col(time), newest, decay_minutes), F.lit(0.0))

    return both.select(
        "query", (F.coalesce("old_n", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("n"), (seen("old_mass", "old_newest") + seen("mass", "newest")).alias("mass"),
        newest.alias("newest"), F.least("old_age", "age").alias("age"),
    )


def state_activity(state: DataFrame, as_of: datetime, decay_minutes: float = RECENCY_DECAY_MINUTES) -> DataFrame:
    """``query_activity`` of the history that a state stands for."""
    recency = F.coalesce(F.col("mass") * recency_weight(F.col("newest"), as_of, decay_minutes), F.lit(0.0))
    return state.select("query", "n", recency.alias("recency"), F.struct("age", "query").alias("first_row"))


def stream_trends(
    history_stream: DataFrame,
    history_path: str,
    trends_path: str,
    checkpoint: str,
    embed_fn: EmbedFn,
    trigger: dict | None = None,
    state_path: str | None = None,
    phrase_fn: PhraseFn | None = None,
    eps: float = DEFAULT_EPS,
    min_samples: int = DEFAULT_MIN_SAMPLES,
    min_cluster_size: int = MIN_CLUSTER_SIZE,
    top_n: int = TOP_N_TRENDS,
    buckets: int = BUCKETS,
    **embed_options,
) -> StreamingQuery:
    """Append each batch of searches to the history, then rank trends as of its newest row.

    The trends are those of ``trend_job`` over the whole history, but the history is not read again. Under ``state_path``
    (by default beside the checkpoint) lie a row per text, into which a batch is merged, and the embedding of every
    text, so that the model is asked for new texts only, once each, also when it has no embedding for one. Rows that
    other jobs stored before the first batch are taken in with it.
    """
    root = state_path or f"{checkpoint.rstrip('/')}-state"

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        texts = BucketTable(spark, f"{root}/texts", TEXT_STATE, ["query"], buckets)
        vectors = BucketTable(spark, f"{root}/vectors", TEXT_VECTORS, ["query"], buckets)
        typed = {"created_at": timestamp(F.col("created_at"))}
        typed.update({c: F.col(c).cast("string") for c in ("id", "chat_id")})
        _write_batch(batch.withColumns(typed), history_path, batch_id)
        stored = existing(spark, history_path, HISTORY_INPUT, "batch_id")
        own = existing(spark, f"{history_path}/batch_id={batch_id}", HISTORY_INPUT)
        first = texts.is_empty(batch_id)
        # later batches may be stored already when a batch is replayed
        rows = stored.filter(F.coalesce(F.col("batch_id") <= batch_id, F.lit(True))).drop("batch_id") if first else own
        with scratch_scope(spark):
            new = materialize(text_state(normalized(read_history(rows))), "new_texts")
            unseen = materialize(vectors.unknown(new.filter("query <> ''").select("query"), batch_id), "unseen")
            vectors.append(materialize(embed_distinct(unseen, "query", embed_fn, **embed_options), "new_vectors"), batch_id)
            texts.merge(new, batch_id, merged_state)
            as_of: datetime | None = own.agg(F.date_format(F.max("created_at"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("t")).first()["t"]
            if as_of is None:
                return
            moment = datetime.fromisoformat(as_of)
            activity = materialize(state_activity(texts.read(batch_id + 1), moment), "activity")
            known = vectors.read(batch_id + 1).filter("embedding IS NOT NULL")

            def label(asked: DataFrame) -> DataFrame:
                return label_texts(materialize(asked.select("query", "n", "first_row").join(known, "query"), "texts"), eps, min_samples)

            result = rank_activity(activity, moment, label, phrase_fn, min_cluster_size, top_n)
            if result.trends is not None:
                persist_trends(result.trends, trends_path, moment, batch_id=f"stream-{batch_id}")

    return _start(history_stream, each, checkpoint, trigger)


def _state_tables(spark: SparkSession, state_path: str, buckets: int) -> tuple[BucketTable, BucketTable, BucketTable]:
    return (
        BucketTable(spark, f"{state_path}/seen", SEEN, ["kind", "Id"], buckets),
        BucketTable(spark, f"{state_path}/shares", SHARES, ["share_id"], buckets),
        BucketTable(spark, f"{state_path}/totals", schemas.STATS, ["video_id"], buckets),
    )


def _merged_shares(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Shares with their video, once it is known, and all their posts."""
    both = stored.unionByName(new).groupBy("share_id")
    return both.agg(F.bool_or("known").alias("known"), F.max("video_id").alias("video_id"), F.sum("posts").alias("posts"))


def _merged_totals(stored: DataFrame, new: DataFrame) -> DataFrame:
    counts = [f"{k}_count" for k in INTERACTION_KINDS]
    return stored.unionByName(new).groupBy("video_id").agg(*[F.sum(c).alias(c) for c in counts])


def stream_stats(
    interactions: DataFrame,
    state_path: str,
    checkpoint: str,
    trigger: dict | None = None,
    videos: DataFrame | None = None,
    reports: DataFrame | None = None,
    stats_path: str | None = None,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Keep counts of interactions (``kind``, ``Id``, ``VideoId``, ``VideoShareId``).

    An interaction counts once however often and however late it arrives. Ids lie in hash buckets, and a batch is
    compared with the ids of its own buckets only; buckets of many small files are rewritten as one. Posts are counted by
    share and added to the share's video as soon as both are known, whichever comes first. Totals have a row per video and
    are merged in place. With ``videos``, ``reports`` and ``stats_path`` every batch publishes a new version of the
    statistics. Interactions without an id count nothing, as in the batch job.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen, shares, totals = _state_tables(spark, state_path, buckets)
        with scratch_scope(spark):
            typed = {c: F.col(c).cast("bigint") for c in ("Id", "VideoId", "VideoShareId")}
            rows = batch.withColumns(typed).filter("Id IS NOT NULL").select("kind", *typed).dropDuplicates(["kind", "Id"])
            fresh = materialize(seen.unknown(materialize(rows, "interactions"), batch_id), "fresh")
            posts = fresh.filter("kind = 'post' AND VideoShareId IS NOT NULL").groupBy(F.col("VideoShareId").alias("share_id"))
            told = fresh.filter("kind = 'share'").select(F.col("Id").alias("share_id"), F.lit(True).alias("known"), F.col("VideoId").alias("video_id"), F.lit(0).cast("bigint").alias("posts"))
            counted = posts.agg(F.lit(False).alias("known"), F.lit(None).cast("bigint").alias("video_id"), F.count(F.lit(1)).alias("posts"))
            new = materialize(_merged_shares(told, counted), "new_shares")
            old = shares.read(batch_id, shares.touched(new)).select("share_id", F.col("known").alias("was_known"), F.col("video_id").alias("old_video"), F.col("posts").alias("old_posts"))
            # posts that had to wait for their share come with it
            waiting = F.when(F.coalesce("was_known", F.lit(False)), 0).otherwise(F.coalesce("old_posts", F.lit(0)))
            arrived = new.join(old, "share_id", "left").filter(F.col("known") | F.coalesce("was_known", F.lit(False)))
            arrived = arrived.select(F.coalesce("video_id", "old_video").alias("video_id"), F.lit("post").alias("kind"), (F.col("posts") + waiting).alias("n"))
            direct = fresh.filter(F.col("kind").isin("like", "view", "share")).groupBy(F.col("VideoId").alias("video_id"), "kind").agg(F.count(F.lit(1)).alias("n"))
            counts = [F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(f"{k}_count") for k in INTERACTION_KINDS]
            delta = materialize(direct.unionByName(arrived).filter("video_id IS NOT NULL").groupBy("video_id").agg(*counts), "delta")
            seen.append(fresh.select("kind", "Id"), batch_id)
            shares.merge(new, batch_id, _merged_shares)
            totals.merge(delta, batch_id, _merged_totals)
        if stats_path is not None:
            overwrite_stats(streamed_stats(videos, reports, state_path, buckets=buckets), stats_path)

    return _start(interactions, each, checkpoint, trigger)


def streamed_stats(videos: DataFrame, reports: DataFrame, state_path: str, null_aware: bool = True, buckets: int = BUCKETS) -> DataFrame:
    """The statistics of all interactions a ``stream_stats`` query has taken in so far; a row per video is read."""
    per_video = _state_tables(videos.sparkSession, state_path, buckets)[2].read()
    kept = exclude_reported(videos.select("id"), reports, null_aware).withColumnRenamed("id", "video_id")
    return kept.join(per_video, "video_id", "left").select(
        "video_id", *[F.coalesce(f"{k}_count", F.lit(0)).alias(f"{k}_count") for k in INTERACTION_KINDS]
    )


def stream_ingest(
    stream: DataFrame, kind: str, table_path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Append dropped parquet files (``kind`` is ``videos`` or ``segments``) to their table.

    The file source hands over each file once. A video id that is already stored stops the
    query, as in the batch job.
    """
    schema, vector = {
        "videos": (schemas.VIDEOS, "text_embedding"), "segments": (schemas.SEGMENTS, "segment_embedding")
    }[kind]

    def each(batch: DataFrame, batch_id: int) -> None:
        rows = unnest_vector(batch, vector)
        if kind == "videos":
            rows = conform(rows.withColumnRenamed("video_id", "id"), schema)
            stored = existing(batch.sparkSession, table_path, schema, "_batch")
            earlier = stored.filter(~F.col("_batch").eqNullSafe(batch_id)).select("id")
            twice = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id")
            clash = twice.union(rows.select("id").join(earlier, "id", "left_semi")).first()
            if clash:
                raise DuplicateVideoError(f"duplicate video id: {clash['id']}")
        else:
            rows = conform(rows.withColumn("id", F.expr("uuid()")), schema)
        _write_batch(rows, table_path, batch_id)

    return _start(stream, each, checkpoint, trigger)


def file_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of the parquet files dropped below a folder, as paths; their contents are read by no one but who asks."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
    reader = reader.option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    return reader.option("maxFilesPerTrigger", str(files_per_batch)).load(folder)


def stream_mixed_ingest(
    stream: DataFrame,
    videos_path: str,
    segments_path: str,
    quarantine_path: str,
    checkpoint: str,
    dim: int | None = None,
    dedupe: bool = False,
    trigger: dict | None = None,
    state_path: str | None = None,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Append the rows of a mixed ``file_stream`` of video and segment files to their tables.

    Files are told apart by name and opened in tasks, whatever the types of their columns. What cannot be taken in goes to
    ``quarantine_path`` (``path``, ``place`` in the file or NULL for all of it, ``video_id``, ``error``) and does not stop the
    stream: files with a vector of another width than ``dim``, values of another type or a video without an id, and videos
    whose id is stored already or came earlier in the batch. With ``dedupe`` known and repeated (video, index) pairs of
    segments are left out silently, as in ``ingest_parquet``. Known keys lie in hash buckets under ``state_path`` (by default
    beside the checkpoint), of which a batch reads its own; rows that other jobs stored before the first batch count.
    """
    root = state_path or f"{checkpoint.rstrip('/')}-state"
    pair = ["video_id", "segment_index"]

    def known_keys(spark: SparkSession, name: str, schema: StructType, table_path: str, table: StructType, batch_id: int) -> BucketTable:
        keys = BucketTable(spark, f"{root}/{name}", schema, schema.names, buckets)
        if keys.is_empty(batch_id):
            # the keys of all rows but those that a replayed batch and its successors wrote
            stored = existing(spark, table_path, table, "_batch").filter(F.coalesce(F.col("_batch") < batch_id, F.lit(True)))
            keys.append(stored.select(*schema.names).distinct(), batch_id - 1)
        return keys

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        is_segment = is_segment_file(F.col("path"))
        with scratch_scope(spark):
            # paths that tasks cannot open come with their contents
            first = batch.select("path").first()
            if first is None:
                return
            files = batch.select("path", *["content"] * (store_of(first["path"]) is None))
            found = {
                name: materialize(read_files(files.filter(wanted), kind, dim, collect_errors=True), name)
                for name, kind, wanted in (("videos", VIDEO_FILES, ~is_segment), ("segments", SEGMENT_FILES, is_segment))
            }
            rows = {name: df.filter("_error IS NULL") for name, df in found.items()}
            place = F.col("_place").alias("place")
            refused = [df.filter("_error IS NOT NULL").select(F.col("_file").alias("path"), place, F.lit(None).cast("string").alias("video_id"), F.col("_error").alias("error")) for df in found.values()]

            ids = known_keys(spark, "video_ids", VIDEO_KEYS, videos_path, schemas.relaxed(schemas.VIDEOS), batch_id)
            own = F.struct("_file", "_place")
            # the first row of each id in this batch, by file and place
            firsts = materialize(rows["videos"].groupBy("id").agg(F.min(own).alias("first")), "first_videos")
            fresh = materialize(ids.unknown(firsts, batch_id), "fresh_videos")
            taken = rows["videos"].join(fresh, "id", "left").withColumn("new", F.coalesce(own == F.col("first"), F.lit(False)))
            taken = materialize(taken, "taken_videos")
            again = taken.filter("NOT new").select(F.col("_file").alias("path"), place, F.col("id").alias("video_id"), F.lit("duplicate video id").alias("error"))

            parts = rows["segments"]
            if dedupe:
                pairs = known_keys(spark, "segment_keys", SEGMENT_KEYS, segments_path, schemas.relaxed(schemas.SEGMENTS), batch_id)
                parts = materialize(pairs.unknown(parts.dropDuplicates(pair), batch_id), "fresh_segments")
            _write_batch(conform(taken.filter("new").select(*schemas.VIDEOS.names), schemas.VIDEOS), videos_path, batch_id)
            _write_batch(conform(parts.withColumn("id", F.expr("uuid()")), schemas.SEGMENTS), segments_path, batch_id)
            _write_batch(refused[0].unionByName(refused[1]).unionByName(again), quarantine_path, batch_id)
            ids.append(fresh.select("id"), batch_id)
            if dedupe:
                pairs.append(parts.select(*pair), batch_id)

    return _start(stream, each, checkpoint, trigger)


def stream_query_volume(
    history_stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, **options
) -> StreamingQuery:
    """Append the final event-time windows of ``windowed_query_volume`` to a table."""
    windows = windowed_query_volume(history_stream, **options)
    writer = windows.writeStream.outputMode("append").format("parquet").option("path", path)
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
