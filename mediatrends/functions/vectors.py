"""Vector columns: shape checks, distances, and the NumPy form used inside Arrow tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

METRICS = ("cosine", "l2")


def check_metric(metric: str) -> str:
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    return metric


def unnest_vector(df: DataFrame, name: str) -> DataFrame:
    """Make ``name`` an ARRAY<FLOAT>, taking the first vector where it holds a list of them."""
    kind = df.schema[name].dataType
    vector = F.col(name)
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, ArrayType):
        vector = F.when(vector.isNotNull(), F.coalesce(F.get(vector, F.lit(0)), F.array().cast(kind.elementType)))
    return df.withColumn(name, vector.cast("array<float>"))


def has_embedding(c: Column | str) -> Column:
    return F.coalesce(F.size(c) > 0, F.lit(False))


def check_dim(c: Column, dim: int) -> Column:
    """The vector itself; a query error where its width is not ``dim``."""
    wrong = F.raise_error(F.concat(F.lit(f"expected {dim} dimensions, not "), F.size(c).cast("string")))
    return F.when(c.isNull() | (F.size(c) == dim), c).otherwise(wrong.cast("array<float>"))


def _doubles(c: Column) -> Column:
    return c.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y)
    total = F.aggregate(products, F.lit(0.0), lambda s, x: s + x)
    wrong = F.raise_error(F.lit("vectors differ in width")).cast("double")
    return F.when(F.size(a) == F.size(b), total).otherwise(wrong)


def normalize_vector(c: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    length = F.sqrt(dot(c, c))
    return F.transform(_doubles(c), lambda x: F.when(length > 0, x / length).otherwise(x))


def cosine_distance(a: Column, b: Column, zero_vector: str = "nan") -> Column:
    """1 minus the cosine. A zero vector has distance NaN, or 1 with ``zero_vector="one"``."""
    lengths = F.sqrt(dot(a, a) * dot(b, b))
    undefined = F.lit(1.0 if zero_vector == "one" else float("nan"))
    return F.when(lengths > 0, 1 - dot(a, b) / lengths).otherwise(undefined)


def l2_distance(a: Column, b: Column) -> Column:
    squares = F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y))
    total = F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)
    wrong = F.raise_error(F.lit("vectors differ in width")).cast("double")
    return F.when(F.size(a) == F.size(b), F.sqrt(total)).otherwise(wrong)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column as a 2-D array of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        raise ValueError("NULL vector")
    rows = len(column)
    values = column.flatten().to_numpy(zero_copy_only=False)
    widths = np.diff(column.offsets.to_numpy())
    if rows and (widths != widths[0]).any():
        raise ValueError("vectors differ in width")
    return values.astype(np.float64).reshape(rows, -1) if rows else np.zeros((0, 0))


def unit_rows(rows: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, lengths, out=np.zeros_like(rows), where=lengths > 0)


def pairwise(a: np.ndarray, b: np.ndarray, metric: str, zero_vector: str = "one") -> np.ndarray:
    """Distances between all rows of two task-local blocks, in double precision."""
    if a.shape[1] != b.shape[1]:
        raise ValueError("vectors differ in width")
    if metric == "cosine":
        distances = np.clip(1.0 - unit_rows(a) @ unit_rows(b).T, 0.0, 2.0)
        if zero_vector == "nan":
            distances[~a.any(axis=1), :] = np.nan
            distances[:, ~b.any(axis=1)] = np.nan
        return distances
    squares = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0.0))


def rowwise(metric: str):
    """Arrow UDF for the distance between two vector columns of the same row."""
    check_metric(metric)

    @F.arrow_udf("double")
    def distance(a: pa.Array, b: pa.Array) -> pa.Array:
        left, right = matrix(a), matrix(b)
        if metric == "cosine":
            return pa.array(np.clip(1.0 - (unit_rows(left) * unit_rows(right)).sum(1), 0.0, 2.0))
        return pa.array(np.sqrt(((left - right) ** 2).sum(1)))

    return distance


def distance_to(vector: list[float], metric: str, zero_vector: str = "nan"):
    """Arrow UDF for the distance of a vector column to one fixed vector."""
    check_metric(metric)
    target = np.asarray(vector, dtype=np.float64).reshape(1, -1)

    @F.arrow_udf("double")
    def distance(column: pa.Array) -> pa.Array:
        if len(column) == 0:
            return pa.array([], pa.float64())
        return pa.array(pairwise(matrix(column), target, metric, zero_vector)[:, 0])

    return distance
