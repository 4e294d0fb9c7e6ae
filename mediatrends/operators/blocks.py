"""Distances between all pairs of rows, computed block against block.

Rows are cut into blocks of bounded size and every pair of blocks is one task that
multiplies two small matrices. Kernels never return the distance matrix: they return
counts, forests, minima, or the pairs within a radius.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from mediatrends.functions.vectors import matrix, pairwise, unit_rows
from mediatrends.session import SHIP_LIMIT_BYTES, materialize

BLOCK_ROWS = 4096
# Blocks are not cut smaller than this only to occupy more cores.
MIN_BLOCK_ROWS = 1024
# Below this many blocks the search for prunable block pairs costs more than it saves.
PRUNE_FROM_BLOCKS = 16
# A row meets every block, so blocks grow with the table: to this part of it, or until their vectors have so many bytes.
BLOCKS = 32
BLOCK_BYTES = 8 << 20
# Products are taken for so many pairs at a time, distances of single pairs for so many, and kernels get the pairs of a step.
PRODUCTS = 1 << 20
PAIR_STEP = 1 << 11
STEP_PAIRS = 1 << 23
# The bound reads coordinates until the rest of the vectors has this part of what would make all pairs seem close.
REST = 0.1
# With more than one in so many pairs left, whole distances are cheaper than single ones.
DENSE = 8
# With more than this part of the coordinates to read, all are read: then the products tell the distances.
WHOLE = 0.75
# Covers, for each coordinate, the rounding of the products in single precision that the bounds compare.
SLACK = 3 * 2.0**-23

LEFT, RIGHT, BOTH = 0, 1, 2


class Side:
    """One block inside a task: its table and its vectors."""

    def __init__(self, table: pa.Table):
        self.table = table
        self.vectors = matrix(table.column("vector"))

    def part(self, rows: np.ndarray) -> "Side":
        return Side(self.table.filter(pa.array(rows)))

    def __len__(self) -> int:
        return self.table.num_rows

    def __getitem__(self, name: str) -> np.ndarray:
        values = self.table.column(name).to_numpy()
        return values.astype(str) if values.dtype == object else values


class _Prefix:
    """A bound on distances from the first few coordinates of the vectors of two blocks.

    Coordinates come by falling energy. The product of the rest of two vectors is at most the product of its lengths
    (Cauchy-Schwarz), so a pair whose first coordinates are too unlike is further apart than ``reach`` whatever the rest
    holds, and whole distances are only computed for the other pairs. The lengths are one more coordinate, and on the
    Euclidean metric half the squares of the vectors are two more, so that a single product tells the bound. It is taken
    in single precision; what that may round off counts as near.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, metric: str, reach: float, whole: float = 1.0):
        self.metric, self.reach = metric, reach
        self.a, self.b = (unit_rows(a), unit_rows(b)) if metric == "cosine" else (a, b)
        energy = (self.a**2).mean(0) + (self.b**2).mean(0)
        order = np.argsort(-energy, kind="stable")
        left = 1 - np.cumsum(energy[order]) / max(energy.sum(), 1e-300)
        # what the rest of a pair of typical length may add to a product before all pairs seem close
        room = 1 - reach if metric == "cosine" else 1 - reach**2 / max(energy.sum(), 1e-300)
        self.width = min(int(np.searchsorted(-left, -REST * room)) + 1, len(order)) if room > 0 else len(order)
        if self.width > whole * len(order):
            self.width = len(order)
        self.whole = self.width == len(order)
        first, rest = order[: self.width], order[self.width :]
        squares_a, squares_b = (self.a**2).sum(1), (self.b**2).sum(1)
        scale = 1.0 if metric == "cosine" else max(np.sqrt(max(squares_a.max(), squares_b.max())), reach, 1e-100)
        self.known = bool(np.isfinite(scale) and np.isfinite(energy).all())
        near = [np.c_[v[:, first], np.sqrt((v[:, rest] ** 2).sum(1))] / scale for v in (self.a, self.b)]
        self.scale, self.least = scale, 1 - reach
        if metric == "l2":
            half_a, half_b = squares_a / (2 * scale**2), squares_b / (2 * scale**2)
            near = [np.c_[near[0], -half_a, np.ones(len(a))], np.c_[near[1], np.ones(len(b)), -half_b]]
            self.least = -((reach / scale) ** 2) / 2
        self.slack = SLACK * (near[0].shape[1] + 4)
        self.least -= self.slack
        self.near_a, self.near_b = (v.astype(np.float32) for v in near)

    def candidates(self, rows: slice) -> np.ndarray:
        """The pairs of some rows of ``a`` with all of ``b`` that may be within reach."""
        chosen, step = self.near_a[rows], max(1, PRODUCTS // len(self.near_b))
        found = np.empty((len(chosen), len(self.near_b)), bool)
        for start in range(0, len(chosen), step):
            at = slice(start, start + step)
            np.greater_equal(chosen[at] @ self.near_b.T, np.float32(self.least), out=found[at])
        return found

    def levels(self, rows: slice, eps_list: list[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs of some rows of ``a`` with all of ``b`` within the last radius, and the place of the first that covers each.

        The products, which hold all coordinates here, tell it unless they are as near to a radius as they may be rounded;
        those few distances are computed in double.
        """
        chosen, columns = self.near_a[rows], len(self.near_b)
        step = max(1, PRODUCTS // columns)
        at, value = [], []
        for start in range(0, len(chosen), step):
            product = (chosen[start : start + step] @ self.near_b.T).ravel()
            found = np.flatnonzero(product >= np.float32(self.least))
            at.append(found + start * columns)
            value.append(product[found])
        i, j = np.divmod(np.concatenate(at), columns)
        i += rows.start
        eps, apart = np.asarray(eps_list, np.float64), -np.concatenate(value).astype(np.float64)
        limits = eps - 1 if self.metric == "cosine" else (eps / self.scale) ** 2 / 2
        level, upper = np.searchsorted(limits, apart - self.slack, side="left"), np.searchsorted(limits, apart + self.slack, side="left")
        unsure = np.flatnonzero(level != upper)
        level[unsure] = np.searchsorted(eps, self.distances(i[unsure], j[unsure]), side="left")
        near = level < len(eps)
        return i[near], j[near], level[near]

    def distances(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Distances of single pairs."""
        out = np.empty(len(i))
        for start in range(0, len(i), PAIR_STEP):
            at = slice(start, start + PAIR_STEP)
            x, y = self.a[i[at]], self.b[j[at]]
            if self.metric == "cosine":
                out[at] = np.clip(1.0 - np.einsum("ij,ij->i", x, y), 0.0, 2.0)
            else:
                x -= y
                out[at] = np.sqrt(np.einsum("ij,ij->i", x, x))
        return out


def _bound(a: Side, b: Side, metric: str, reach: float, whole: float = 1.0) -> _Prefix:
    if a.vectors.shape[1] != b.vectors.shape[1]:
        raise ValueError("vectors differ in width")
    return _Prefix(a.vectors, b.vectors, metric, reach, whole)


def close_levels(a: Side, b: Side, metric: str, eps_list: list[float]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of a row of ``a`` and one of ``b`` within the last of the ascending radii, with the place of the first that
    covers them; a row is at 0 from itself."""
    if not len(a) or not len(b):
        return
    bound = _bound(a, b, metric, eps_list[-1], WHOLE)
    if not bound.known or not bound.whole:
        for i, j, distance in close_steps(a, b, metric, eps_list[-1], bound):
            yield i, j, np.searchsorted(eps_list, distance, side="left")
        return
    step, first = max(1, STEP_PAIRS // len(b)), np.searchsorted(eps_list, 0.0, side="left")
    for start in range(0, len(a), step):
        rows = slice(start, min(start + step, len(a)))
        i, j, level = bound.levels(rows, eps_list)
        if a is b:
            apart, own = i != j, np.arange(rows.start, rows.stop)
            i, j, level = np.r_[i[apart], own], np.r_[j[apart], own], np.r_[level[apart], np.full(len(own), first)]
        yield i, j, level


def close_steps(
    a: Side, b: Side, metric: str, reach: float, bound: _Prefix | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of a row of ``a`` and one of ``b`` within ``reach``, with their distance; a row is at 0 from itself."""
    if not len(a) or not len(b):
        return
    bound = bound or _bound(a, b, metric, reach)
    step = max(1, STEP_PAIRS // len(b))
    for start in range(0, len(a), step):
        rows = slice(start, min(start + step, len(a)))
        found = bound.candidates(rows) if bound.known else None
        if found is None or np.count_nonzero(found) > found.size // DENSE:
            distances = pairwise(a.vectors[rows], b.vectors, metric)
            i, j = np.nonzero(distances <= reach)
            d = distances[i, j]
        else:
            i, j = np.divmod(np.flatnonzero(found.ravel()), len(b))
            d = bound.distances(i + start, j)
            near = d <= reach
            i, j, d = i[near], j[near], d[near]
        i = i + start
        if a is b:
            apart, own = i != j, np.arange(rows.start, rows.stop)
            i, j, d = np.r_[i[apart], own], np.r_[j[apart], own], np.r_[d[apart], np.zeros(len(own))]
        yield i, j, d


Kernel = Callable[[Side, Side], Iterable[dict]]


@dataclass
class BlockPairs:
    """Points with a ``block``: its number, or with ``n_tiles`` the list of tiles (pairs of blocks) that a point goes to."""

    points: DataFrame
    n_blocks: int
    n_tiles: int | None = None

    def _tiles(self, df: DataFrame) -> DataFrame:
        if self.n_tiles is not None:
            return df.withColumn("at", F.explode("block")).select("*", "at.*").drop("at")
        other = F.explode(F.sequence(F.lit(0), F.lit(self.n_blocks - 1)))
        low, high = F.least("block", "other"), F.greatest("block", "other")
        tile = low.cast("bigint") * F.lit(self.n_blocks) + high
        side = F.when(low == high, BOTH).when(F.col("block") == low, LEFT).otherwise(RIGHT)
        return df.withColumn("other", other).withColumn("tile", tile).withColumn("side", side).drop("other")

    def run(self, df: DataFrame, kernel: Kernel, schema: str) -> DataFrame:
        """Apply ``kernel`` to every admitted pair of blocks of ``df`` (a subset of the points)."""
        n_tiles = self.n_blocks * (self.n_blocks + 1) // 2 if self.n_tiles is None else self.n_tiles
        tasks = max(1, min(n_tiles, max(8 * df.sparkSession.sparkContext.defaultParallelism, n_tiles // 8)))

        arrow_schema = to_arrow_schema(StructType.fromDDL(schema))

        def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(list(batches))
            side = table.column("side").to_numpy()
            left, right = Side(table.filter(pa.array(side != RIGHT))), Side(table.filter(pa.array(side == RIGHT)))
            if not len(left):
                return
            pairs = [(left, left)] * bool((side == BOTH).any()) + [(left, right)] * bool(len(right))
            for a, b in pairs:
                for columns in kernel(a, b):
                    yield pa.RecordBatch.from_pydict(columns, arrow_schema)

        tiled = self._tiles(df).drop("block")
        spread = F.pmod(F.xxhash64("tile"), F.lit(tasks)).cast("int")
        return tiled.repartitionById(tasks, spread).groupBy("tile").applyInArrow(tile, schema)


def tile_pairs(left: DataFrame, right: DataFrame, block_rows: int) -> BlockPairs:
    """Each row of ``left`` against each of ``right`` (the same columns, and ``row``), cut by hash into blocks of about ``block_rows``."""
    sizes = [max(1, math.ceil(df.count() / block_rows)) for df in (left, right)]

    def placed(df: DataFrame, side: int) -> DataFrame:
        own = F.pmod(F.xxhash64("row"), F.lit(sizes[side]))
        step, other = (sizes[1], 1) if side == LEFT else (1, sizes[1])
        tile = lambda at: F.struct((own * step + at * other).cast("bigint").alias("tile"), F.lit(side).alias("side"))
        return df.withColumn("block", F.transform(F.sequence(F.lit(0), F.lit(sizes[1 - side] - 1)), tile))

    return BlockPairs(placed(left, LEFT).unionByName(placed(right, RIGHT)), sum(sizes), sizes[0] * sizes[1])


def _hash_blocks(points: DataFrame, n_blocks: int) -> DataFrame:
    return points.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("int"))


def _tiles_of(parts: np.ndarray, halo_parts: np.ndarray):
    """Arrow UDF for the tiles of a point from its cell, its halo cells and a number that spreads it over parts.

    Of a cell with ``p`` parts and a halo of ``h`` parts, each part meets each halo part in a tile, and itself in the
    first of them; each two parts meet in a tile of their own.
    """
    first_halo = np.maximum(halo_parts, 1)
    sizes = parts * first_halo + parts * parts
    base = np.cumsum(sizes) - sizes

    @F.arrow_udf("array<struct<tile: bigint, side: int>>")
    def tiles(cells: pa.Array, halos: pa.Array, spread: pa.Array) -> pa.Array:
        out = []
        for cell, halo, key in zip(cells.to_pylist(), halos.to_pylist(), spread.to_pylist()):
            p, h, at = int(parts[cell]), int(first_halo[cell]), int(base[cell])
            own = key % p
            mine = [{"tile": at + own * h + i, "side": LEFT if i else BOTH} for i in range(h)]
            mine += [{"tile": at + p * h + min(own, j) * p + max(own, j), "side": LEFT if own < j else RIGHT} for j in range(p) if j != own]
            for c in halo:
                step, place = int(first_halo[c]), key % int(halo_parts[c])
                mine += [{"tile": int(base[c]) + i * step + place, "side": RIGHT} for i in range(int(parts[c]))]
            out.append(mine)
        return pa.array(out, pa.list_(pa.struct([("tile", pa.int64()), ("side", pa.int32())])))

    n_tiles = int((parts * first_halo + parts * (parts - 1) // 2).sum())
    return tiles, n_tiles


def _local_blocks(points: DataFrame, n_pivots: int, reach: float, metric: str, block_rows: int, most_copies: int | None) -> BlockPairs | None:
    """Blocks of nearby points, each with the points around it that may be within ``reach`` of one of its own.

    Points go to the cell of the nearest of ``n_pivots`` pivots. By the triangle inequality a cell holds no point within
    reach of one that is further from its pivot than its radius plus the reach; all other points of later cells are its
    halo. So a point is sent to its own cell and to earlier cells around it, not to every block, and each pair meets once.
    Crowded cells and halos are cut by hash. On the cosine metric all this is applied to chords of unit vectors, where
    distance d is a chord of sqrt(2 d). Only pivots and numbers of cells pass through the driver. None if this would send
    ``most_copies`` rows or more: vectors without clusters have halos of all points.
    """
    chosen = points.orderBy(F.xxhash64("row"), "row").limit(n_pivots).select("vector").toArrow()
    shape = unit_rows if metric == "cosine" else np.asarray
    pivots = shape(matrix(chosen.column("vector")))

    @F.arrow_udf("cell int, gap double")
    def locate(vectors: pa.Array) -> pa.Array:
        distances = pairwise(shape(matrix(vectors)), pivots, "l2")
        cell = distances.argmin(axis=1)
        gap = distances[np.arange(len(cell)), cell]
        return pa.StructArray.from_arrays([pa.array(cell, pa.int32()), pa.array(gap)], ["cell", "gap"])

    located = materialize(points.withColumn("_at", locate("vector")).select("*", "_at.*").drop("_at"), "cells")
    cells = located.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("radius")).collect()  # at most the pivots
    size, radius = np.zeros(len(pivots), np.int64), np.full(len(pivots), -np.inf)
    for c in cells:
        size[c["cell"]], radius[c["cell"]] = c["n"], c["radius"]
    chord = math.sqrt(2 * reach) if metric == "cosine" else reach

    @F.arrow_udf("array<int>")
    def around(vectors: pa.Array, own: pa.Array) -> pa.Array:
        distances = pairwise(shape(matrix(vectors)), pivots, "l2")
        # the slack covers rounding of the distances
        near = (distances <= radius[None, :] + chord + 1e-6) & (np.arange(len(pivots))[None, :] < own.to_numpy(zero_copy_only=False)[:, None])
        row, cell = np.nonzero(near)
        ends = np.cumsum(np.bincount(row, minlength=len(near)))
        return pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(cell, pa.int32()))

    placed = materialize(located.withColumn("halo", around("vector", "cell")).drop("gap"), "halos")
    halo_size = np.zeros(len(pivots), np.int64)
    for c in placed.select(F.explode("halo").alias("cell")).groupBy("cell").count().collect():  # at most the pivots
        halo_size[c["cell"]] = c["count"]
    parts, halo_parts = -(-size // block_rows), -(-halo_size // block_rows)
    copies = int((size * (np.maximum(halo_parts, 1) + parts - 1) + halo_size * parts).sum())
    if most_copies is not None and copies >= most_copies:
        return None
    tiles, n_tiles = _tiles_of(parts, halo_parts)
    spread = F.xxhash64("row").bitwiseAND((1 << 62) - 1)
    blocks = placed.withColumn("block", tiles("cell", "halo", spread)).drop("cell", "halo")
    return BlockPairs(materialize(blocks, "block_pairs"), int(parts.sum()), n_tiles)


def block_pairs(
    points: DataFrame,
    metric: str,
    reach: float | None = None,
    block_rows: int = BLOCK_ROWS,
    n_blocks: int | None = None,
    prune: bool | None = None,
) -> BlockPairs:
    """Cut ``points`` (unique ``row``, ``vector``, more) into blocks for pairwise work.

    There are enough blocks to bound a block to about ``block_rows`` rows, or a ``BLOCKS``-th part of the table as long as
    its vectors have at most ``BLOCK_BYTES``, and to give every core a pair. ``n_blocks`` asks for more. With a ``reach``
    and many blocks, pairs that are provably too far apart are left out, however many blocks there are; unless ``prune``
    asks for that, only where it spares copies of rows.
    """
    total, width = points.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    largest = max(block_rows, BLOCK_BYTES // (8 * max(width or 1, 1)))
    block_rows = max(block_rows, min(math.ceil(total / BLOCKS), largest))
    if n_blocks is None:
        cores = points.sparkSession.sparkContext.defaultParallelism
        n_blocks = max(1, math.ceil(total / block_rows), min(math.ceil(math.sqrt(2 * cores)), total // MIN_BLOCK_ROWS))
    n_blocks = max(n_blocks, math.ceil(total / largest))
    if prune or prune is None and n_blocks >= PRUNE_FROM_BLOCKS:
        if reach is not None and total:
            # pivots and their distances fit in a task; beyond that many blocks, cells hold several
            n_pivots = max(1, min(n_blocks, SHIP_LIMIT_BYTES // (8 * max(width, 1)), math.isqrt(SHIP_LIMIT_BYTES // 8)))
            local = _local_blocks(points, n_pivots, reach, metric, block_rows, None if prune else total * n_blocks)
            if local is not None:
                return local
    return BlockPairs(_hash_blocks(points, n_blocks), n_blocks)


def eps_pairs(
    points: DataFrame,
    eps: float,
    metric: str = "cosine",
    id_col: str = "id",
    vector_col: str = "embedding",
    n_blocks: int | None = None,
    prune: bool | None = None,
    block_rows: int = 2048,
) -> DataFrame:
    """All pairs ``src < dst`` at a distance of at most ``eps``, with their distance."""
    kind = points.schema[id_col].dataType.simpleString()
    rows = points.select(F.col(id_col).alias("row"), F.col(vector_col).alias("vector"))
    blocks = block_pairs(rows, metric, eps, block_rows, n_blocks=n_blocks, prune=prune)

    def close(a: Side, b: Side) -> Iterator[dict]:
        left, right = a["row"], b["row"]
        for i, j, distance in close_steps(a, b, metric, eps):
            src, dst = left[i], right[j]
            wanted = src < dst if a is b else np.ones(len(src), bool)
            src, dst, distance = src[wanted], dst[wanted], distance[wanted]
            first = src < dst
            yield {
                "src": np.where(first, src, dst),
                "dst": np.where(first, dst, src),
                "distance": distance,
            }

    return blocks.run(blocks.points, close, f"src {kind}, dst {kind}, distance double")
