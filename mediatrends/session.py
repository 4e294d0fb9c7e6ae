"""Session settings, scratch tables and size checks shared by all operators."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    # mean vectors are kept per cluster in memory up to this many clusters per task
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "1024",
}

# Largest amount of vector data (bytes) an operator may ship to every executor.
SHIP_LIMIT_BYTES = 64 * 1024 * 1024

_local_scratch: dict[str, tempfile.TemporaryDirectory] = {}


def build_session(app_name: str = "mediatrends", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; ``conf`` overrides them."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    This is the folder named by ``spark.checkpoint.dir``. Only a local session without
    that setting falls back to a temporary folder; on a cluster it is an error, because
    executors could not read each other's files.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    local = spark.sparkContext.master.startswith("local")  # local-cluster runs on one machine, too
    if configured:
        if configured.startswith("file:") and not local:
            raise RuntimeError("spark.checkpoint.dir names a folder of one machine")
        return configured.rstrip("/")
    if not local:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.TemporaryDirectory(prefix="mediatrends-")
    return _local_scratch[app].name


@dataclass
class Scratch:
    """Scratch tables made inside a ``scratch_scope``."""

    paths: list[str] = field(default_factory=list)
    kept: list[str] = field(default_factory=list)

    def keep(self, df: DataFrame) -> DataFrame:
        """Hand a scratch table on to the caller of the scope."""
        self.kept.append(df.scratch_path)
        return df


class _Scopes(threading.local):
    """Open scopes of a thread; a streaming batch runs in a thread of its own."""

    def __init__(self) -> None:
        self.open: list[Scratch] = []


_scopes = _Scopes()


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[Scratch]:
    """Delete the scratch tables made inside, except those kept, when the block ends.

    Kept tables belong to the enclosing scope, if there is one. Operators that loop or
    that read a table several times use a scope, so a run leaves only its result behind.
    """
    scope = Scratch()
    _scopes.open.append(scope)
    try:
        yield scope
    finally:
        _scopes.open.pop()
        if _scopes.open:
            _scopes.open[-1].paths += scope.kept
        for path in scope.paths:
            if path not in scope.kept:
                delete_path(spark, path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and return the table as read back.

    Cuts the lineage for iterative operators and survives the loss of executors. The
    read-back table has exact size statistics, so later joins are planned from real sizes.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/mediatrends/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scopes.open:
        _scopes.open[-1].paths.append(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any store that Spark knows; one that is not there is no error."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(table: DataFrame) -> None:
    """Delete a scratch table that no later step reads."""
    delete_path(table.sparkSession, table.scratch_path)


def with_row_order(df: DataFrame, order_by: list[Column], name: str = "row_order") -> DataFrame:
    """Add a BIGINT that sorts like ``order_by``; values are increasing but have gaps.

    Uses a distributed range sort, never a window over the whole table. The result is a
    scratch table, because range boundaries are sampled and must not be drawn twice.
    """
    ordered = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    return materialize(ordered.withColumn(name, F.monotonically_increasing_id()), name)


def with_row_number(df: DataFrame, order_by: list[Column], name: str = "row_number") -> DataFrame:
    """Add the dense 0-based position of every row in the order ``order_by``.

    The only window runs over one row per sort partition.
    """
    ordered = with_row_order(df, order_by, "_position")
    # fixed by monotonically_increasing_id: partition number above 33 bits of row number
    part, local = F.shiftright("_position", 33), F.col("_position").bitwiseAND((1 << 33) - 1)
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    return (
        ordered.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")  # one row per sort partition
        .withColumn(name, F.col("_start") + local)
        .drop("_part", "_start", "_position")
    )
