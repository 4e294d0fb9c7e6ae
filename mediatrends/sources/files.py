"""Files listed and read inside tasks, whatever the types of their columns.

Folders are listed level by level and files are opened one by one in tasks, so no list of paths passes the driver. Stores
that Arrow has no access to are listed by Spark, and their files reach the tasks as bytes.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from mediatrends import schemas
from mediatrends.session import materialize

BATCH_ROWS = 4096
# Rows of a listing that a task passes on at a time.
LISTED = 10_000
_PLACE = "_file string, _place bigint, _error string"


def store_of(uri: str) -> tuple[fs.FileSystem, str, str] | None:
    """The store of a qualified path, the path inside it, and what stands before that; None if Arrow cannot reach it."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/"), "file:"
    try:
        store, inner = fs.FileSystem.from_uri(quote(uri, safe=":/@"))
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return None
    return (store, inner, uri[: len(uri) - len(inner)]) if uri.endswith(inner) else None


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of its store, which for a plain path is the session's default."""
    given = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return given.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(given).toString()


def _listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries of each folder, but for those that Spark takes as hidden, too."""
    for batch in batches:
        for folder in batch["folder"].to_pylist():
            store, inner, before = store_of(folder)
            found = [e for e in store.get_file_info(fs.FileSelector(inner, allow_not_found=True)) if e.base_name[:1] not in ("_", ".")]
            for start in range(0, len(found), LISTED):
                part = found[start : start + LISTED]
                columns = {
                    "path": [before + e.path for e in part], "length": pa.array([e.size for e in part], pa.int64()),
                    "is_folder": [e.type == fs.FileType.Directory for e in part],
                }
                yield pa.RecordBatch.from_pydict(columns)


def _walk(spark: SparkSession, folders: list[str]) -> DataFrame:
    """``path`` and ``length`` of all files below ``folders``, those of zero bytes included; one round per level."""
    level, files = spark.createDataFrame([(f,) for f in folders], "folder string"), []
    while True:
        # a folder is a row; tasks take some each
        spread = level.repartition(spark.sparkContext.defaultParallelism)
        found = materialize(spread.mapInArrow(_listing, "path string, length bigint, is_folder boolean"), "listing")
        files.append(found.filter("NOT is_folder").select("path", "length"))
        level = found.filter("is_folder").select(F.col("path").alias("folder"))
        if level.isEmpty():
            break
    result = files[0]
    for more in files[1:]:
        result = result.unionByName(more)
    return result


def list_files(spark: SparkSession, paths: str | list[str], suffix: str = "") -> DataFrame:
    """``path`` and ``length`` of the files at or below ``paths`` (folders, files or globs); contents are not read."""
    folders, others = [], []
    for path in [paths] if isinstance(paths, str) else paths:
        store = None if any(c in path for c in "*?[{") else store_of(qualified(spark, path))
        is_folder = store is not None and store[0].get_file_info(store[1]).type == fs.FileType.Directory
        (folders if is_folder else others).append(qualified(spark, path) if is_folder else path)
    found = []
    if folders:
        walked = _walk(spark, folders)
        found.append(walked.filter(F.endswith("path", F.lit(suffix))) if suffix else walked)
    if others:
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        if suffix:
            reader = reader.option("pathGlobFilter", f"*{suffix}")
        found.append(reader.load(others).select("path", "length"))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def with_content(spark: SparkSession, files: DataFrame, paths: str | list[str], suffix: str) -> DataFrame:
    """``files`` as they are if tasks can open the stores of ``paths``; else listed again with their ``content``."""
    given = [paths] if isinstance(paths, str) else list(paths)
    if all(store_of(qualified(spark, p)) for p in given):
        return files
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}")
    return reader.load(given).select("path", "content").join(files.select("path"), "path", "left_semi")


# --- one file -----------------------------------------------------------------------------


def first_vectors(column: pa.Array) -> pa.Array:
    """A column of vectors, or of lists of them, of which the first is taken, as lists of floats; empty if there is none."""
    kind = column.type
    if pa.types.is_fixed_size_list(kind) or pa.types.is_large_list(kind):
        column = column.cast(pa.list_(kind.value_type))
    if not pa.types.is_list(column.type):
        # a column that is null in all rows of a file is stored as some other type
        return pa.nulls(len(column), pa.list_(pa.float32()))
    inner_kind = column.type.value_type
    if pa.types.is_list(inner_kind) or pa.types.is_large_list(inner_kind) or pa.types.is_fixed_size_list(inner_kind):
        inner = column.values.cast(pa.list_(inner_kind.value_type))
        starts = column.offsets.to_numpy()[:-1].astype(np.int64)
        filled = np.diff(column.offsets.to_numpy()) > 0
        known = np.zeros(len(starts), bool)
        known[filled] = inner.is_valid().to_numpy(zero_copy_only=False)[starts[filled]]
        empty = pa.array([[]], inner.type)
        places = pa.array(np.where(known, starts, len(inner)), mask=column.is_null().to_numpy(zero_copy_only=False))
        column = pa.concat_arrays([inner, empty]).take(places)
    return column.cast(pa.list_(pa.float32()), safe=False)


def as_type(column: pa.Array, kind: pa.DataType) -> pa.Array:
    """A scalar column in the type of its table; text is read as a number where one is asked for."""
    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    if pa.types.is_null(column.type):
        return pa.nulls(len(column), kind)
    text = pa.types.is_string(column.type) or pa.types.is_large_string(column.type)
    if text and not pa.types.is_string(kind):
        column = pc.utf8_trim_whitespace(column)
    return column.cast(kind, safe=text)


def _plain(value, kind: pa.DataType):
    """A value as JSON can hold it; fields without a value are left out."""
    if value is None:
        return None
    if pa.types.is_struct(kind):
        return {f.name: _plain(value[f.name], f.type) for f in kind if value[f.name] is not None}
    if pa.types.is_map(kind):
        return {str(k): _plain(v, kind.item_type) for k, v in value}
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        return [_plain(v, kind.value_type) for v in value]
    if isinstance(value, bytes):
        return base64.b64encode(value).decode()
    return value if isinstance(value, (str, int, float, bool)) else str(value)


def json_texts(column: pa.Array | None, n: int) -> pa.Array:
    """Metadata of any shape as JSON text; text stays as it is, and missing metadata is the JSON text ``null``."""
    if column is None or pa.types.is_null(column.type):
        return pa.array(["null"] * n)
    if pa.types.is_nested(column.type):
        column = pa.array([json.dumps(_plain(v, column.type), ensure_ascii=False, separators=(",", ":")) for v in column.to_pylist()], pa.string())
    return pc.fill_null(as_type(column, pa.string()), "null")


class Kind:
    """How files of one kind become rows of their table."""

    def __init__(self, schema: StructType, vector: str, renamed: dict[str, str] | None = None, as_json: str | None = None, required: str | None = None) -> None:
        self.schema, self.vector, self.renamed, self.as_json, self.required = schema, vector, renamed or {}, as_json, required
        self.arrow = to_arrow_schema(schemas.relaxed(schema))

    def rows(self, batch: pa.RecordBatch, dim: int | None) -> pa.RecordBatch:
        columns = []
        for field in self.arrow:
            name = self.renamed.get(field.name, field.name)
            given = batch[name] if name in batch.schema.names else None
            if name == self.as_json:
                column = json_texts(given, batch.num_rows)
            elif given is None:
                column = pa.nulls(batch.num_rows, field.type)
            elif name == self.vector:
                column = first_vectors(given)
                widths = pc.list_value_length(column).drop_null().unique().to_pylist()
                wrong = [w for w in widths if dim is not None and w != dim]
                if wrong:
                    raise ValueError(f"expected {dim} dimensions, not {wrong[0]}")
                column = column.cast(field.type)
            else:
                column = as_type(given, field.type)
            if field.name == self.required and column.null_count:
                raise ValueError(f"{name} is required")
            columns.append(column)
        return pa.RecordBatch.from_arrays(columns, schema=self.arrow)


SEGMENT_FILES = Kind(StructType(schemas.SEGMENTS.fields[1:]), "segment_embedding")
VIDEO_FILES = Kind(schemas.VIDEOS, "text_embedding", {"id": "video_id"}, "video_metadata", "id")


def _batches(path: str, content: bytes | None, kind: Kind) -> Iterator[pa.RecordBatch]:
    if content is None:
        store, inner, _ = store_of(path)
        source = store.open_input_file(inner)
    else:
        source = pa.BufferReader(content)
    with pq.ParquetFile(source) as file:
        names = [f.name for f in file.schema_arrow]
        if not names:
            return  # a file without columns holds nothing
        wanted = [n for n in (kind.renamed.get(f.name, f.name) for f in kind.arrow) if n in names]
        yield from file.iter_batches(BATCH_ROWS, columns=wanted or names[:1])


def read_files(files: DataFrame, kind: Kind, dim: int | None = None, collect_errors: bool = False) -> DataFrame:
    """The rows of ``files`` (``path``, and ``content`` where tasks cannot open the path), each opened in a task.

    A vector whose width is not ``dim`` or a value that is not of its type ends the query; with ``collect_errors`` such a
    file gives one row with ``_file`` and ``_error`` and no other, and all rows tell their ``_file`` and ``_place`` in it. A
    file is then converted whole before its rows are passed on.
    """
    content = "content" in files.columns
    placed = pa.schema([*kind.arrow, ("_file", pa.string()), ("_place", pa.int64()), ("_error", pa.string())])

    def converted(path: str, held: bytes | None) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in _batches(path, held, kind):
            rows = kind.rows(batch, dim)
            if collect_errors:
                more = [pa.array([path] * len(rows)), pa.array(np.arange(at, at + len(rows))), pa.nulls(len(rows), pa.string())]
                rows = pa.RecordBatch.from_arrays([*rows.columns, *more], schema=placed)
                at += len(rows)
            yield rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch["content"].to_pylist() if content else [None] * batch.num_rows
            for path, own in zip(batch["path"].to_pylist(), held):
                if not collect_errors:
                    yield from converted(path, own)
                    continue
                try:
                    rows = list(converted(path, own))
                except (ValueError, pa.ArrowException, OSError) as error:
                    rows = [pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in kind.arrow), pa.array([path]), pa.nulls(1, pa.int64()), pa.array([str(error)])], schema=placed)]
                yield from rows

    schema = StructType(schemas.relaxed(kind.schema).fields)
    if collect_errors:
        schema = StructType([*schema.fields, *StructType.fromDDL(_PLACE).fields])
    spread = files.select("path", *["content"] * content).repartition(files.sparkSession.sparkContext.defaultParallelism)
    return spread.mapInArrow(run, schema)
