"""Exact density-based clustering (DBSCAN) for one or many parameter settings.

No step lists all close pairs. Per pair of blocks the passes return (1) neighbour counts,
(2) a spanning forest of the core points and (3) the least cluster next to each border
point, so the data between passes grows with rows times blocks even if a third of the
points are within reach of each other. Points that fit in a single block take all three
passes in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from mediatrends.functions.vectors import check_metric
from mediatrends.operators.blocks import BLOCK_ROWS, BOTH, RIGHT, BlockPairs, Side, block_pairs, close_levels, close_steps, tile_pairs
from mediatrends.operators.components import connected_components
from mediatrends.session import materialize, scratch_scope, with_row_number, with_row_order

# Radius and density of the trend clusters, and the label of noise.
DEFAULT_EPS = 0.418182
DEFAULT_MIN_SAMPLES = 2
NOISE = -1

NO_CLUSTER = np.iinfo(np.int64).max

# From so many blocks on, points are first joined to the largest cluster by a few pairs of blocks.
JOIN_FROM_BLOCKS = 8


def _neighbour_counts(metric: str, eps_list: list[float]):
    """Weighted neighbours within each radius, the point itself included."""
    names = [f"n{level}" for level in range(len(eps_list))]

    def kernel(a: Side, b: Side) -> Iterator[dict]:
        weight_a, weight_b = a["weight"], b["weight"]
        count_a = np.zeros((len(eps_list), len(a)))
        count_b = np.zeros((len(eps_list), len(b)))
        for i, j, level in close_levels(a, b, metric, eps_list):
            # the neighbours that each radius adds to those of the radius before
            count_a += np.bincount(level * len(a) + i, weight_b[j], len(eps_list) * len(a)).reshape(count_a.shape)
            if a is not b:
                count_b += np.bincount(level * len(b) + j, weight_a[i], len(eps_list) * len(b)).reshape(count_b.shape)
        yield {"row": a["row"], **dict(zip(names, np.cumsum(count_a, axis=0)))}
        if a is not b:
            yield {"row": b["row"], **dict(zip(names, np.cumsum(count_b, axis=0)))}

    return kernel, "row long, " + ", ".join(f"{name} double" for name in names)


def _join_roots(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Join the components of each pair: roots hook to the least root they meet, until none is left (Boruvka)."""
    while True:
        ru, rv = root[u], root[v]
        apart = ru != rv
        if not apart.any():
            return
        u, v, ru, rv = u[apart], v[apart], ru[apart], rv[apart]
        np.minimum.at(root, np.maximum(ru, rv), np.minimum(ru, rv))
        while True:
            jumped = root[root]
            if np.array_equal(jumped, root):
                break
            root[:] = jumped


class _Forests:
    """The components of some nodes at each of ``limit`` levels, as the least node of each."""

    def __init__(self, nodes: int, limit: int) -> None:
        self.roots = np.tile(np.arange(nodes), (limit, 1))

    def add(self, u: np.ndarray, v: np.ndarray, level: np.ndarray) -> None:
        """Join pairs from their level on; pairs that are joined there already cost one look."""
        start, size = 0, self.roots.shape[1]
        while start < len(u):  # few pairs first: most later ones are joined by then
            part = slice(start, start + size)
            self._add(u[part], v[part], level[part])
            start, size = start + size, 2 * size

    def _add(self, u: np.ndarray, v: np.ndarray, level: np.ndarray) -> None:
        new = self.roots[level, u] != self.roots[level, v]
        u, v, level = u[new], v[new], level[new]
        active = np.zeros(0, np.int64)
        for at in range(int(level.min(initial=len(self.roots))), len(self.roots)):
            active, root = np.r_[active, np.flatnonzero(level == at)], self.roots[at]
            # a pair that was joined at a level before is joined at all greater ones
            active = active[root[u[active]] != root[v[active]]]
            _join_roots(root, u[active], v[active])


def _joined(a: Side, b: Side, metric: str, eps_list: list[float], place: np.ndarray, cores: list[tuple]) -> list[_Forests]:
    """The components of the core points of two blocks, a forest for each density setting.

    A pair joins at the first radius that covers its distance and makes both ends core; ``cores`` tells that level of
    the rows of both blocks, and ``place`` numbers them. Settings with the same core levels here share a forest.
    """
    limit = len(eps_list)
    names = [(core_a.tobytes(), core_b.tobytes()) for core_a, core_b in cores]
    distinct = {name: (core, _Forests(int(place.max(initial=-1)) + 1, limit)) for name, core in zip(names, cores)}
    for i, j, base in close_levels(a, b, metric, eps_list):
        if a is b:
            i, j, base = i[i < j], j[i < j], base[i < j]
        u, v = place[i], place[j if a is b else j + len(a)]
        for (core_a, core_b), forest in distinct.values():
            level = np.maximum(base, np.maximum(core_a[i], core_b[j]))
            both = level < limit
            forest.add(u[both], v[both], level[both])
    return [distinct[name][1] for name in names]


def _core_forest(metric: str, eps_list: list[float], settings: int):
    """Components of the core points per density setting, as an edge a point: to the least one at the first radius that
    joins it to a lesser one. The edges of all radii up to one connect what that radius connects. Points with the same
    ``node`` are joined from the first radius on."""
    limit = len(eps_list)

    def kernel(a: Side, b: Side) -> Iterator[dict]:
        name = "node" if "node" in a.table.column_names else "row"
        nodes, place = np.unique(a[name] if a is b else np.concatenate([a[name], b[name]]), return_inverse=True)
        cores = [(a[f"core{s}"], b[f"core{s}"]) for s in range(settings)]
        for setting, forest in enumerate(_joined(a, b, metric, eps_list, place, cores)):
            linked = forest.roots != np.arange(len(nodes))
            src = np.flatnonzero(linked[-1])  # what is joined at a radius is joined at all greater ones
            if len(src):
                level = linked[:, src].argmax(axis=0)
                which = np.full(len(src), setting, np.int32)
                yield {"setting": which, "level": level.astype(np.int32), "src": nodes[src], "dst": nodes[forest.roots[level, src]]}

    return kernel, "setting int, level int, src long, dst long"


def _core_roots(cores: DataFrame, edges: DataFrame, levels: int, settings: int) -> DataFrame:
    """``config``, ``row``, ``root`` of the core points, one radius after another.

    The edges of a radius join the components of the radius before, so each edge is read for one radius only.
    """
    each = F.explode(F.array(*[F.struct(F.lit(j).alias("setting"), F.col(f"core{j}").alias("level")) for j in range(settings)])).alias("at")
    rooted = cores.select("row", "node", each).select("at.*", "row", F.col("node").alias("root")).filter(F.col("level") < levels)
    found, joined = [], False
    for level in range(levels):
        new = edges.filter(F.col("level") == level).select("setting", "src", "dst")
        if joined:
            for end in ("src", "dst"):
                names = rooted.select("setting", F.col("row").alias(end), "root")
                new = new.join(names, ["setting", end]).drop(end).withColumnRenamed("root", end)
        new = materialize(new.filter("src <> dst").distinct(), "joins")
        if not new.isEmpty():
            components = connected_components(new, ["setting"]).withColumnRenamed("id", "root")
            placed = rooted.join(components, ["setting", "root"], "left").withColumn("root", F.coalesce("component", "root"))
            rooted, joined = materialize(placed.drop("component"), "rooted"), True
        config = (F.col("setting") * levels + level).cast("int").alias("config")
        found.append(rooted.filter(F.col("level") <= level).select(config, "row", "root"))
    return materialize(reduce(DataFrame.union, found), "roots")


def _joined_nodes(blocks: BlockPairs, cores: DataFrame, metric: str, eps: float, settings: int) -> DataFrame | None:
    """``row``, ``node`` of the points that a few pairs of blocks show to be one cluster in all settings; None if these are
    less than half of the core points.

    Points that are core at the first radius ``eps`` of each density are joined inside their block and with the first
    block. Those of the largest component need not meet again: ``node`` is its least row.
    """
    if blocks.n_tiles is not None or blocks.n_blocks < JOIN_FROM_BLOCKS:
        return None
    dense = cores.filter(F.col(f"core{settings - 1}") == 0).select("row")
    half = cores.count() / 2
    if dense.count() < half:
        return None
    own = F.struct(F.col("block").cast("bigint").alias("tile"), F.lit(BOTH).alias("side"))
    first = F.transform(F.sequence(F.lit(1), F.lit(blocks.n_blocks - 1)), lambda tile: F.struct(tile.cast("bigint").alias("tile"), F.lit(RIGHT).alias("side")))
    star = blocks.points.select("block", "row", "vector").join(dense, "row")
    star = star.withColumn("block", F.when(F.col("block") == 0, F.concat(F.array(own), first)).otherwise(F.array(own)))
    kernel, schema = _links(metric, eps)
    met = BlockPairs(star, blocks.n_blocks, blocks.n_blocks).run(star, kernel, schema)
    joined = materialize(met.filter("row <> root").select(F.col("row").alias("src"), F.col("root").alias("dst")), "star")
    found = connected_components(joined)
    largest = found.groupBy("component").count().orderBy(F.desc("count"), "component").first()
    if largest is None or largest["count"] < half:
        return None
    return found.filter(F.col("component") == largest["component"]).select(F.col("id").alias("row"), F.col("component").alias("node"))


def _whole_block(metric: str, eps_list: list[float], min_samples_list: list[int]):
    """The clusters of points that are a single block: counts, components and borders in one task."""
    limit = len(eps_list)
    count, _ = _neighbour_counts(metric, eps_list)

    def kernel(a: Side, b: Side) -> Iterator[dict]:
        (counted,) = count(a, a)
        counts = np.array([counted[f"n{i}"] for i in range(limit)])
        rows = a["row"]
        place = np.argsort(np.argsort(rows))
        ordered = np.sort(rows)
        # the first radius at which a point is core
        cores = [np.where((counts >= m).any(axis=0), (counts >= m).argmax(axis=0), limit) for m in min_samples_list]
        forests = _joined(a, a, metric, eps_list, place, [(c, c) for c in cores])
        configs, roots = [], []
        for setting, (core, forest, m) in enumerate(zip(cores, forests, min_samples_list)):
            for level, root in enumerate(forest.roots):
                is_core, config = core <= level, setting * limit + level
                own = ordered[root[place]]
                if is_core.any():
                    yield {"config": np.full(is_core.sum(), config, np.int32), "row": rows[is_core], "root": own[is_core], "is_core": np.ones(is_core.sum(), bool)}
                if m > 2 and is_core.any() and not is_core.all():
                    configs.append(config)
                    roots.append(np.where(is_core, own, NO_CLUSTER))
        if configs:
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * len(configs), pa.int32()), pa.array(np.stack(roots, axis=1).ravel()))
            border, _ = _border_roots(metric, eps_list, configs)
            side = Side(a.table.append_column("roots", listed))
            for found in border(side, side):
                yield {**found, "is_core": np.zeros(len(found["row"]), bool)}

    return kernel, "config int, row long, root long, is_core boolean"


def _border_roots(metric: str, eps_list: list[float], configs: list[int]):
    """Least root of the core points within reach of each point that is not core."""
    radius = np.array([config % len(eps_list) for config in configs])

    def kernel(a: Side, b: Side) -> Iterator[dict]:
        for side, other in [(a, b)] if a is b else [(a, b), (b, a)]:
            own, roots = _roots(side), _roots(other)
            border, core = (own == NO_CLUSTER).any(axis=1), (roots != NO_CLUSTER).any(axis=1)
            if not border.any() or not core.any():
                continue
            own, roots, row = own[border], roots[core], side["row"][border]
            least = np.full(own.shape, NO_CLUSTER)
            # the last radius at which a point is not core: it has few neighbours there, and those further off don't matter
            until = np.where(own == NO_CLUSTER, radius, -1).max(axis=1)
            for i, j, distance in close_steps(side.part(border), other.part(core), metric, eps_list[until.max()]):
                level = np.searchsorted(eps_list, distance, side="left")
                near = level <= until[i]
                i, j, level = i[near], j[near], level[near]
                for place in range(len(configs)):
                    close = level <= radius[place]
                    np.minimum.at(least[:, place], i[close], roots[j[close], place])
            found, place = np.nonzero((own == NO_CLUSTER) & (least != NO_CLUSTER))
            if len(found):
                yield {"config": np.array(configs, np.int32)[place], "row": row[found], "root": least[found, place]}

    return kernel, "config int, row long, root long"


def _roots(side: Side) -> np.ndarray:
    return side.table.column("roots").combine_chunks().flatten().to_numpy().reshape(len(side), -1)


def density_clusters(
    blocks: BlockPairs, metric: str, eps_list: list[float], min_samples_list: list[int]
) -> DataFrame:
    """``config``, ``row``, ``root``, ``is_core`` of all points that are not noise.

    ``config`` is the place of (min_samples, eps) in the product of the ascending lists;
    ``root`` is the least core row of the cluster.
    """
    levels, settings = len(eps_list), len(min_samples_list)
    points = blocks.points
    if blocks.n_blocks == 1:
        kernel, schema = _whole_block(metric, eps_list, min_samples_list)
        return blocks.run(points.select("block", "row", "vector", "weight"), kernel, schema)
    kernel, schema = _neighbour_counts(metric, eps_list)
    counts = blocks.run(points.select("block", "row", "vector", "weight"), kernel, schema)
    counts = counts.groupBy("row").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(levels)])

    def core_level(min_samples: int) -> Column:
        dense = [F.when(F.col(f"n{i}") >= min_samples, i) for i in range(levels)]
        return F.coalesce(*dense, F.lit(levels))

    cores = counts.select("row", *[core_level(m).alias(f"core{j}") for j, m in enumerate(min_samples_list)])
    cores = materialize(cores.filter(F.least(F.lit(levels), *[f"core{j}" for j in range(settings)]) < levels), "cores")

    joined = _joined_nodes(blocks, cores, metric, eps_list[0], settings)
    kernel, schema = _core_forest(metric, eps_list, settings)
    if joined is None:
        core_points = points.select("block", "row", "vector").join(cores, "row")
        cores = cores.withColumn("node", F.col("row"))
        edges = materialize(blocks.run(core_points, kernel, schema), "forests")
    else:
        cores = materialize(cores.join(joined, "row", "left"), "nodes")
        core_points = points.select("row", "vector").join(cores.withColumn("node", F.coalesce("node", "row")), "row")
        others = core_points.join(cores.filter("node IS NULL").select("row"), "row", "left_semi")
        tiles = tile_pairs(others, core_points, math.ceil(points.count() / blocks.n_blocks))
        edges = materialize(tiles.run(tiles.points, kernel, schema), "forests")
        cores = cores.withColumn("node", F.coalesce("node", "row"))
    rooted = _core_roots(cores, edges, levels, settings)
    labelled = rooted.withColumn("is_core", F.lit(True))

    # with whole weights, a point next to a core point is itself core if two suffice
    configs = [j * levels + i for j, m in enumerate(min_samples_list) if m > 2 for i in range(levels)]
    always_core = cores.filter(F.greatest(F.lit(0), *[f"core{j}" for j in range(settings)]) == 0)
    total, always = points.count(), always_core.count()
    if not configs or always == total:
        return labelled
    per_row = rooted.filter(F.col("config").isin(configs)).groupBy("row").pivot("config", configs)
    roots = per_row.agg(F.first("root"))
    filled = [F.coalesce(F.col(str(c)), F.lit(int(NO_CLUSTER))) for c in configs]
    with_roots = points.select("block", "row", "vector").join(roots, "row", "left")
    kernel, schema = _border_roots(metric, eps_list, configs)
    with_roots = with_roots.select("block", "row", "vector", F.array(*filled).alias("roots"))
    if blocks.n_tiles is None and blocks.n_blocks >= JOIN_FROM_BLOCKS and total - always <= total / 2:
        # few points are not core: they go to all others, and the others not to each other
        with_roots = materialize(with_roots.drop("block"), "bordered")
        blocks = tile_pairs(with_roots.join(always_core.select("row"), "row", "left_anti"), with_roots, math.ceil(total / blocks.n_blocks))
        with_roots = blocks.points
    border = blocks.run(with_roots, kernel, schema)
    border = border.groupBy("config", "row").agg(F.min("root").alias("root")).withColumn("is_core", F.lit(False))
    return labelled.union(border)


def dbscan_points(
    points: DataFrame, id_col: str, vector_col: str, weight_col: str | None, order_by: list[Column] | None
) -> DataFrame:
    """Scratch table of ``row`` (sorts like ``order_by``), id, vector and weight."""
    weight = F.lit(1.0) if weight_col is None else F.col(weight_col).cast("double")
    columns = [F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), weight.alias("weight")]
    if order_by is None and isinstance(points.schema[id_col].dataType, IntegralType):
        return materialize(points.select(F.col(id_col).cast("bigint").alias("row"), *columns), "row")
    order = F.struct(*(order_by or [F.col(id_col)])).alias("_order")
    return with_row_order(points.select(*columns, order), [F.col("_order")], "row").drop("_order")


def _links(metric: str, eps: float):
    """Links of each row to others within reach, and the least row it is connected to inside the two blocks."""

    def kernel(a: Side, b: Side) -> Iterator[dict]:
        nodes = a["row"] if a is b else np.concatenate([a["row"], b["row"]])
        by_row = np.argsort(nodes)
        place = np.empty(len(nodes), np.int64)
        place[by_row] = np.arange(len(nodes))
        nodes, count, forest = nodes[by_row], np.zeros(len(nodes), np.int64), _Forests(len(nodes), 1)
        for i, j, _ in close_steps(a, b, metric, eps):
            if a is b:
                i, j = i[i < j], j[i < j]
            u, v = place[i], place[j if a is b else j + len(a)]
            count += np.bincount(u, minlength=len(nodes)) + np.bincount(v, minlength=len(nodes))
            forest.add(u, v, np.zeros(len(u), np.int64))
        found = np.flatnonzero(count)
        yield {"row": nodes[found], "n_links": count[found], "root": nodes[forest.roots[0][found]]}

    return kernel, "row long, n_links long, root long"


def linked(
    points: DataFrame,
    eps: float,
    metric: str = "cosine",
    id_col: str = "id",
    vector_col: str = "embedding",
    n_blocks: int | None = None,
    prune: bool | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``id``, ``component_id`` and ``n_links`` of every point, for the links of all pairs at a distance of at most ``eps``.

    ``n_links`` counts the other points within ``eps``; a component is named by its least id. This is the whole similarity
    join, but its pairs stay in their tasks: a pair of blocks returns a row for each of its points that has a link.
    """
    check_metric(metric)
    with scratch_scope(points.sparkSession) as scope:
        chosen = points.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
        rows = with_row_order(chosen, [F.col("id")], "row")
        blocks = block_pairs(rows.drop("id"), metric, eps, block_rows, n_blocks, prune)
        kernel, schema = _links(metric, eps)
        met = materialize(blocks.run(blocks.points, kernel, schema), "links")
        components = connected_components(met.filter("row <> root").select(F.col("row").alias("src"), F.col("root").alias("dst")))
        counts = met.groupBy("row").agg(F.sum("n_links").alias("n_links"))
        placed = rows.select("id", "row").join(counts, "row", "left").join(components.withColumnRenamed("id", "row"), "row", "left")
        # rows are in the order of ids
        names = rows.select(F.col("row").alias("component"), F.col("id").alias("component_id"))
        placed = placed.withColumn("component", F.coalesce("component", "row")).join(names, "component")
        return scope.keep(materialize(placed.select("id", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links")), "linked"))


def dbscan(
    points: DataFrame,
    eps: float = DEFAULT_EPS,
    min_samples: int = DEFAULT_MIN_SAMPLES,
    metric: str = "cosine",
    id_col: str = "id",
    vector_col: str = "embedding",
    weight_col: str | None = None,
    order_by: list[Column] | None = None,
    n_blocks: int | None = None,
    prune: bool | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``id``, ``label`` and ``is_core`` of every point.

    A point is core if the weights within ``eps``, its own included, reach
    ``min_samples``. Clusters are numbered by their first core point in ``order_by``
    (default the id); a border point takes the lowest cluster it touches; noise is -1.
    ``weight_col`` counts copies: clustering distinct vectors with their number of copies
    gives the labels of clustering all copies.
    """
    check_metric(metric)
    with scratch_scope(points.sparkSession) as scope:
        rows = dbscan_points(points, id_col, vector_col, weight_col, order_by)
        blocks = block_pairs(rows.drop("id"), metric, eps, block_rows, n_blocks, prune)
        found = materialize(density_clusters(blocks, metric, [eps], [min_samples]), "clusters")
        numbers = with_row_number(found.select("root").distinct(), [F.col("root")], "label")
        labels = found.join(numbers, "root").select("row", "label", "is_core")
        labelled = rows.join(labels, "row", "left").select(
            "id",
            F.coalesce("label", F.lit(NOISE).cast("long")).alias("label"),
            F.coalesce("is_core", F.lit(False)).alias("is_core"),
        )
        return scope.keep(materialize(labelled, "labels"))
