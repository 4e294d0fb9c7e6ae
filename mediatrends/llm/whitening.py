"""Whitening of embeddings with distributed block matrices.

The centred vectors become the rows of a BlockMatrix. The product of its transpose with itself is the scatter matrix,
whose eigenvectors are found locally (a matrix as wide as a vector); a second product, with the whitening matrix,
projects the rows. Sums, deviations and centring use whole numbers, so no digit is lost before the products.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediatrends.llm.common import job, materialize, type_of

SCALE, SHIFT = 64, 1_000_000  # an entry c becomes floor(64 * c) + 1000000
COMPONENTS = 32
# Components whose variance is a smaller share of the greatest one are rounding errors.
LEAST_SHARE = 1e-12
BLOCK_BYTES = 1 << 21  # of a block of rows
BLOCKS_A_TASK = 16  # blocks that one task of the scatter product multiplies and adds up


def _whole(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(SCALE * c.cast("double")).cast("bigint") + SHIFT)


def _usable(vector: Column) -> Column:
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return vector.isNotNull() & F.forall(vector, lambda c: F.coalesce(finite(c.cast("double")), F.lit(False)))


def _numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table with ``row``, the numbers from 0 on without gaps, in the order of the written parts."""
    written = materialize(df.withColumn("place", F.monotonically_increasing_id()), name)
    # fixed by monotonically_increasing_id: partition number above 33 bits of row number
    part, local = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    sizes = written.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n_part"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("n_part").over(before), F.lit(0)).alias("start"))
    placed = written.withColumn("part", part).join(F.broadcast(starts), "part")  # one row per part
    return placed.withColumn("row", F.col("start") + local).drop("part", "start", "place")


def block_matrix(rows: DataFrame, n: int, width: int) -> BlockMatrix:
    """The columns ``row`` and ``values`` (array of doubles) as blocks of whole rows."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("row", array_to_vector("values").alias("vector")), "vector")
    return IndexedRowMatrix(vectors, n, width).toBlockMatrix(max(1, BLOCK_BYTES // (8 * width)), width)


def scatter(blocks: BlockMatrix) -> np.ndarray:
    """The product of the transpose with the matrix.

    Its result is one block. Left alone, the product would send all blocks to the one task of that block; cut
    along the rows, tasks add up some blocks each and only their sums meet.
    """
    cuts = -(-blocks.numRowBlocks // BLOCKS_A_TASK)
    turned = blocks.transpose()
    model = turned._java_matrix_wrapper.call("multiply", blocks._java_matrix_wrapper._java_model, cuts)
    found = BlockMatrix(model, blocks.colsPerBlock, blocks.colsPerBlock).toLocalMatrix().toArray()
    return (found + found.T) / 2


def projected(blocks: BlockMatrix, matrix: np.ndarray) -> DataFrame:
    """``row`` and ``values`` of the product with a local ``matrix``."""
    spark_matrix = Matrices.dense(*matrix.shape, matrix.flatten(order="F"))
    sc = blocks.blocks.context
    right = BlockMatrix(sc.parallelize([((0, 0), spark_matrix)], 1), *matrix.shape, *matrix.shape)
    rows = blocks.multiply(right).toIndexedRowMatrix()
    found = callMLlibFunc("getIndexedRows", rows._java_matrix_wrapper._java_model)
    return found.select(F.col("index").alias("row"), vector_to_array("vector").alias("values"))


def _totals(values: DataFrame, column: str) -> list:
    """The sum of each entry of an array column."""
    summed = values.select(F.posexplode(column).alias("at", "value")).groupBy("at").agg(F.sum("value").alias("total"))
    return [r["total"] for r in summed.orderBy("at").collect()]  # one row per entry of a vector


def whitening_matrix(covariance: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns that project centred rows on unit variance, and the variances, greatest first."""
    variance, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-variance, kind="stable")
    variance, vectors = variance[order], vectors[:, order]
    kept = min(components, int(np.sum(variance > LEAST_SHARE * max(variance[0], 0.0)))) if variance[0] > 0 else 0
    variance, vectors = variance[:kept], vectors[:, :kept]
    # of the two directions, the one whose greatest entry is positive
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(kept)] < 0, -1.0, 1.0)
    return vectors / np.sqrt(variance), variance


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Whitened coordinates of every vector, one row per vector and component.

    ``id_col``, ``component`` (from 1, by falling variance), ``n`` (vectors used), ``deviation`` (squared length of the n-fold
    centred vector, exact; an error if it exceeds 64 bits), ``whitened``, ``explained`` (share of the whole variance) and
    ``identity_error`` (how far the covariance of the whitened rows is from the identity).

    Vectors that are null, or hold null or non-finite entries, are left out; so are those whose width is not the most
    frequent one (the greater one of ties), empty ones included. Repeated rows and ids count as often as they occur, null
    ids too. Components without variance are not listed, so that fewer than two different vectors, or none, give no row.
    """
    spark = vectors.sparkSession
    schema = f"{id_col} {type_of(vectors, id_col)}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    with job(spark) as scope:
        usable = vectors.filter(_usable(F.col(vector_col)) & (F.size(vector_col) > 0))
        whole = materialize(usable.select(F.col(id_col).alias("id"), _whole(F.col(vector_col)).alias("x")), "whole")
        widths = whole.groupBy(F.size("x").alias("width")).agg(F.count(F.lit(1)).alias("n"))
        most = widths.orderBy(F.desc("n"), F.desc("width")).first()
        if most is None:
            return spark.createDataFrame([], schema)
        n, width = most["n"], most["width"]
        whole = whole.filter(F.size("x") == width)
        sums = _totals(whole, "x")
        off = F.zip_with("x", F.lit(sums), lambda x, s: x * F.lit(n).cast("bigint") - s)
        centred = whole.select("id", off.alias("off")).select(
            "id",
            F.aggregate("off", F.lit(0).cast("bigint"), lambda a, v: a + v * v).alias("deviation"),
            F.transform("off", lambda v: v.cast("double") / F.lit(float(n))).alias("values"),
        )
        rows = materialize(_numbered(centred, "centred"), "rows")
        blocks = block_matrix(rows, n, width)
        covariance = scatter(blocks) / n
        matrix, variance = whitening_matrix(covariance, components)
        kept = len(variance)
        if not kept:
            return spark.createDataFrame([], schema)
        white = materialize(projected(blocks, matrix), "white")
        means = [t / n for t in _totals(white, "values")]
        again = white.select("row", F.zip_with("values", F.lit(means), lambda v, m: v - m).alias("values"))
        error = float(np.abs(scatter(block_matrix(again, n, kept)) / n - np.eye(kept)).max())
        shares = (variance / np.trace(covariance)).tolist()
        each = rows.drop("values").join(white, "row").select("id", "deviation", F.posexplode("values").alias("at", "whitened"))
        result = each.select(
            F.col("id").alias(id_col), (F.col("at") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened",
            F.lit(shares)[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"),
        )
        return scope.keep(materialize(result, "whitened"))
