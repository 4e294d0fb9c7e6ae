"""Keyed tables in hash buckets, changed batch by batch.

A bucket is a list of versions, each a folder that one batch wrote; a manifest names the versions of every bucket. A
batch reads and writes only the buckets that its keys fall into and then writes a manifest of its own, which makes its
changes visible at once. A batch that runs again starts from the manifest before it and overwrites what it wrote, so
repeated and interrupted batches change nothing twice. Folders that neither of the last two manifests names are deleted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

from mediatrends.session import delete_path
from mediatrends.sources.writers import existing

BUCKETS = 64
# Versions of a bucket before it is rewritten as one.
DELTAS = 16

_MANIFEST = StructType().add("bucket", IntegerType()).add("versions", ArrayType(LongType()))

Versions = dict[int, list[int]]


class BucketTable:
    """Rows of ``schema`` with unique ``keys`` under ``path``, in ``buckets`` hash buckets.

    The number of buckets is fixed once the table has rows: a manifest with another one is an error.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, keys, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def versions(self, before: int | None = None) -> Versions:
        """Versions of each bucket as of the last batch, or of the last one before ``before``."""
        return self._manifests(before)[0]

    def _manifests(self, before: int | None = None) -> tuple[Versions, list[int]]:
        stored = existing(self.spark, f"{self.path}/manifest", _MANIFEST, "_batch")
        if before is not None:
            stored = stored.filter(F.col("_batch") < before)
        rows = stored.collect()  # one row per bucket of the few manifests that are kept
        batches = sorted({r["_batch"] for r in rows})
        found = {r["bucket"]: list(r["versions"]) for r in rows if r["_batch"] == batches[-1]} if batches else {}
        if -1 in found and found.pop(-1) != [self.buckets]:
            raise ValueError(f"the table in {self.path} has another number of buckets")
        return found, batches

    def is_empty(self, before: int | None = None) -> bool:
        return not self.versions(before)

    def read(self, before: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The rows as of the last batch (before ``before``); of other buckets than ``only`` no file is opened."""
        found = self.versions(before)
        wanted = found if only is None else {b: found[b] for b in only if b in found}
        paths = [f"{self.path}/data/batch_id={v}/bucket={b}" for b, own in wanted.items() for v in own]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets that the keys of ``rows`` fall into."""
        return sorted(r["bucket"] for r in rows.select(self.bucket().alias("bucket")).distinct().collect())  # at most the buckets

    def unknown(self, rows: DataFrame, batch_id: int) -> DataFrame:
        """The ``rows`` whose keys no batch before ``batch_id`` has stored."""
        return rows.join(self.read(batch_id, self.touched(rows)).select(*self.keys), self.keys, "left_anti")

    def append(self, rows: DataFrame, batch_id: int, deltas: int = DELTAS) -> None:
        """Add rows with new keys; a bucket of ``deltas`` versions becomes one."""
        found = self.versions(batch_id)
        touched = self.touched(rows)
        full = [b for b in touched if len(found.get(b, [])) >= deltas]
        if full:
            rows = rows.select(*self.schema.names).unionByName(self.read(batch_id, full))
        self._store(rows, batch_id, found, touched, full)

    def merge(self, rows: DataFrame, batch_id: int, combine: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Replace the buckets of ``rows`` by ``combine(stored rows of these buckets, rows)``."""
        found = self.versions(batch_id)
        touched = self.touched(rows)
        self._store(combine(self.read(batch_id, touched), rows), batch_id, found, touched, touched)

    def _store(self, rows: DataFrame, batch_id: int, found: Versions, touched: list[int], replaced: list[int]) -> None:
        keyed = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema]).withColumn("bucket", self.bucket())
        # keys are spread by their hash, so buckets are of like size
        keyed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/batch_id={batch_id}")
        after = {b: list(v) for b, v in found.items()}
        for bucket in touched:
            after[bucket] = [batch_id] if bucket in replaced else [*after.get(bucket, []), batch_id]
        self._publish(after, batch_id)

    def _publish(self, versions: Versions, batch_id: int) -> None:
        rows = [(-1, [self.buckets]), *sorted(versions.items())]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/batch_id={batch_id}")
        before, batches = self._manifests(batch_id)
        kept = {(b, v) for own in (versions, before) for b, vs in own.items() for v in vs}
        for old in batches[:-1]:
            stale = self._manifests(old + 1)[0]
            for bucket, version in {(b, v) for b, vs in stale.items() for v in vs} - kept:
                delete_path(self.spark, f"{self.path}/data/batch_id={version}/bucket={bucket}")
            delete_path(self.spark, f"{self.path}/manifest/batch_id={old}")
