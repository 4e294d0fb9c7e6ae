"""Readers for media listings, transcripts, per-video parquet files, tables and JSON exports."""

from __future__ import annotations

from pathlib import PurePosixPath
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediatrends import schemas
from mediatrends.functions.text import file_name
from mediatrends.sources.files import SEGMENT_FILES, VIDEO_FILES, Kind, list_files, qualified, read_files, store_of, with_content

# Fixed value: file names that start with this word and "_" hold segments, all others videos.
SEGMENT_PREFIX = "segment"


def list_media(spark: SparkSession, folder: str) -> DataFrame:
    """``path`` and ``size`` of the media files in a folder, those of zero bytes included."""
    found = list_files(spark, folder).withColumnRenamed("length", "size")
    if store_of(qualified(spark, folder)) is not None:
        return found
    # Spark lists such a store; its scan skips files of zero bytes, which only its file index names
    indexed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).inputFiles()
    every = spark.createDataFrame([(unquote(p),) for p in indexed], "path string").select(F.regexp_replace("path", "^file:/+", "file:/").alias("path"))
    empty = every.join(found.select("path"), "path", "left_anti")
    return found.unionByName(empty.select("path", F.lit(0).cast("bigint").alias("size")))


def _read(spark: SparkSession, paths: str | list[str], kind: Kind, dim: int | None, keep: Column | None) -> DataFrame:
    files = list_files(spark, paths, ".parquet")
    files = files if keep is None else files.filter(keep)
    return read_files(with_content(spark, files, paths, ".parquet"), kind, dim)


def is_segment_file(path: Column) -> Column:
    return F.substring_index(file_name(path), "_", 1) == SEGMENT_PREFIX


def read_segments(spark: SparkSession, paths: str | list[str], dim: int | None = None, keep: Column | None = None) -> DataFrame:
    """Segment files as the segments table without ``id``.

    Accepts flat and nested embeddings, times stored as text, and files without columns; files are opened in tasks.
    """
    return _read(spark, paths, SEGMENT_FILES, dim, keep)


def read_videos(spark: SparkSession, paths: str | list[str], dim: int | None = None, keep: Column | None = None) -> DataFrame:
    """Video files as the videos table; metadata of any shape becomes JSON text. A video without an id is an error."""
    return _read(spark, paths, VIDEO_FILES, dim, keep)


def route_parquet(spark: SparkSession, paths: str | list[str], dim: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(videos, segments)`` from a mix of files, told apart by file name."""
    is_segment = is_segment_file(F.col("path"))
    return read_videos(spark, paths, dim, ~is_segment), read_segments(spark, paths, dim, is_segment)


def check_parquet_paths(spark: SparkSession, paths: str | list[str]) -> list[str]:
    """The paths, if each exists and is a ``.parquet`` file or a folder."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    for path in paths:
        suffix = PurePosixPath(path.rstrip("/")).suffix
        if suffix not in ("", ".parquet") and not any(c in path for c in "*?[{"):
            raise ValueError(f"expected a .parquet file: {path}")
        try:
            list_files(spark, path)
        except AnalysisException as error:
            raise FileNotFoundError(f"parquet file not found: {path}") from error
    return paths


def read_transcripts(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """``video_id`` and its ``segments`` (start, end, text)."""
    return spark.read.schema(schemas.TRANSCRIPTS).format(fmt).load(path)


def read_cluster_json(spark: SparkSession, path: str, n_rows: int | None = None) -> DataFrame:
    """``cluster_id`` and ``row_id`` from exported clusters.

    Reads one object ``{"cluster": [row, ...]}`` per file or, as written by
    ``export_clusters_json``, lines of ``cluster_id``, ``part`` and ``rows``. Rows at or
    beyond ``n_rows`` are dropped.
    """
    whole = spark.read.text(path, wholetext=True)
    lines = spark.read.text(path)
    chunk = F.from_json("value", "cluster_id bigint, part bigint, rows array<bigint>")
    chunked = lines.select(chunk.alias("c")).filter("c.rows IS NOT NULL")
    rows = chunked.select("c.cluster_id", F.explode("c.rows").alias("row_id"))
    if chunked.isEmpty():
        clusters = F.explode(F.from_json("value", "map<string, array<bigint>>")).alias("cluster_id", "rows")
        rows = whole.select(clusters).select(F.col("cluster_id").cast("bigint"), F.explode("rows").alias("row_id"))
    return rows if n_rows is None else rows.filter(F.col("row_id") < n_rows)


def read_embeddings_json(spark: SparkSession, path: str) -> DataFrame:
    """``row_id``, ``query`` and ``embedding`` from exported embeddings.

    Reads JSON lines of these three, as the history job writes them, or files that hold one
    object with the parallel lists ``queries`` and ``embeddings`` (such a file is one task's work).
    Any other form is an error.
    """
    lines = spark.read.schema("row_id bigint, query string, embedding array<double>").json(path)
    if not lines.filter("row_id IS NOT NULL").isEmpty():
        missing = F.raise_error(F.lit("a line without row_id")).cast("bigint")
        return lines.withColumn("row_id", F.coalesce("row_id", missing))
    schema = "queries array<string>, embeddings array<array<double>>"
    whole = spark.read.schema(schema).json(path, multiLine=True)
    if not whole.isEmpty() and whole.filter("queries IS NOT NULL AND embeddings IS NOT NULL").isEmpty():
        raise ValueError(f"no embeddings in a known form: {path}")
    pairs = whole.select(F.posexplode(F.arrays_zip("queries", "embeddings")).alias("row_id", "pair"))
    return pairs.select(F.col("row_id").cast("bigint"), F.col("pair.queries").alias("query"), F.col("pair.embeddings").alias("embedding"))


TABLES = {
    "videos": schemas.VIDEOS,
    "video_segments": schemas.SEGMENTS,
    "search_history": schemas.HISTORY,
    "trending_searches": schemas.TRENDS,
    "video_stats": schemas.STATS,
    "video_likes": schemas.INTERACTIONS,
    "video_views": schemas.INTERACTIONS,
    "video_shares": schemas.INTERACTIONS,
    "video_posts": schemas.POSTS,
    "reports": schemas.REPORTS,
}


def read_table(spark: SparkSession, name: str, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """One of the library's tables; ``fmt="jdbc"`` with its options reads a database."""
    if name not in TABLES:
        raise ValueError(f"unknown table: {name}")
    if fmt == "jdbc":
        return spark.read.format("jdbc").options(dbtable=path, **options).load()
    # batches may lie in folders of their own beside files; all are the table's rows
    reader = spark.read.schema(TABLES[name]).format(fmt).option("recursiveFileLookup", "true")
    return reader.options(**options).load(path)
