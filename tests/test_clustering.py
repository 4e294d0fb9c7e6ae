import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from mediatrends.operators import grid, validity
from mediatrends.operators.blocks import block_pairs, eps_pairs
from mediatrends.operators.components import connected_components
from mediatrends.operators.dbscan import dbscan

rng = np.random.default_rng(5)


def blobs(n=260, copies=60):
    """Clouds of different density, stray points, one group of exact copies, a zero vector."""
    centers = rng.normal(size=(5, 6))
    cloud = np.concatenate([c + rng.normal(scale=s, size=(n // 5, 6)) for c, s in zip(centers, (0.1, 0.2, 0.3, 0.4, 0.9))])
    return np.concatenate([cloud, np.repeat(centers[:1], copies, axis=0), np.zeros((1, 6))])[rng.permutation(n + copies + 1)]


POINTS = blobs()


def frame(spark, x, **columns):
    names = list(columns)
    rows = [(i, [float(v) for v in p], *[columns[c][i] for c in names]) for i, p in enumerate(x)]
    return spark.createDataFrame(rows, "id long, embedding array<double>" + "".join(f", {c} double" for c in names))


def labels_of(result):
    rows = sorted(result.collect(), key=lambda r: r["id"])
    return np.array([r["label"] for r in rows]), np.array([r["is_core"] for r in rows])


@pytest.mark.parametrize(
    "eps, min_samples, metric, options",
    [
        (0.05, 2, "cosine", {}),
        (0.03, 6, "cosine", {"n_blocks": 4}),
        (0.35, 5, "l2", {"n_blocks": 5, "prune": True}),
        (0.02, 8, "cosine", {"n_blocks": 6, "prune": True, "block_rows": 25}),
    ],
)
def test_dbscan_matches_brute_force(spark, eps, min_samples, metric, options):
    label, core = brute.dbscan(POINTS, eps, min_samples, metric)
    assert label.max() >= 1 and (label == -1).any()
    got, got_core = labels_of(dbscan(frame(spark, POINTS), eps, min_samples, metric, **options))
    assert (got == label).all() and (got_core == core).all()


def test_weights_stand_for_copies(spark):
    distinct, first, inverse, count = np.unique(POINTS, axis=0, return_index=True, return_inverse=True, return_counts=True)
    rows = frame(spark, distinct, weight=count.astype(float).tolist(), first=first.astype(float).tolist())
    got, _ = labels_of(dbscan(rows, 0.3, 5, "l2", weight_col="weight", order_by=[F.col("first")]))
    label, _ = brute.dbscan(POINTS, 0.3, 5, "l2")
    assert (got[inverse.ravel()] == label).all()


@pytest.mark.parametrize("options", [{}, {"n_blocks": 3}, {"n_blocks": 5, "prune": True, "block_rows": 20}])
@pytest.mark.parametrize("metric, eps", [("cosine", 0.02), ("l2", 0.3)])
def test_eps_pairs(spark, metric, eps, options):
    d = brute.distances(POINTS, metric)
    i, j = np.nonzero(np.triu(d <= eps, 1))
    got = eps_pairs(frame(spark, POINTS), eps, metric, **options).collect()
    assert {(r["src"], r["dst"]) for r in got} == set(zip(i.tolist(), j.tolist())) and len(got) == len(i)
    assert all(abs(r["distance"] - d[r["src"], r["dst"]]) < 1e-6 for r in got)


def test_pruning_leaves_out_far_blocks(spark):
    """Two far clouds: crowded cells are cut and the clouds are never paired."""
    cloud = np.concatenate([rng.normal(scale=0.1, size=(100, 4)), 50 + rng.normal(scale=0.1, size=(80, 4))])
    rows = frame(spark, cloud).select(F.col("id").alias("row"), F.col("embedding").alias("vector"))
    blocks = block_pairs(rows, "l2", 0.5, block_rows=20, n_blocks=8, prune=True)
    assert blocks.n_blocks > 8
    sides = blocks._tiles(blocks.points).groupBy("tile", F.col("side") == 1).count()
    assert sides.agg(F.max("count")).first()[0] < 60
    tiles = blocks._tiles(blocks.points).groupBy("tile").agg(F.min("row").alias("low"), F.max("row").alias("high"))
    assert tiles.filter("low < 100 AND high >= 100").isEmpty()
    assert 0 < blocks.n_tiles < blocks.n_blocks * (blocks.n_blocks + 1) / 2


def test_eps_pairs_with_text_ids(spark):
    rows = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 1.0])], "id string, embedding array<double>")
    assert [tuple(r) for r in eps_pairs(rows, 0.1).collect()] == [("a", "b", 0.0)]


def test_components_on_chain_star_and_loop(spark):
    chain = [("a", i, i + 1) for i in range(40)]
    star = [("b", 0, i) for i in range(1, 300)] + [("b", 900, 901), ("b", 950, 950), ("b", 5, 5)]
    edges = spark.createDataFrame(chain + star, "g string, src long, dst long")
    got = {(r["g"], r["id"]): r["component"] for r in connected_components(edges, ["g"]).collect()}
    assert len(got) == 41 + 300 + 2 + 1
    assert {got["a", i] for i in range(41)} == {0} and {got["b", i] for i in range(300)} == {0}
    assert got["b", 901] == 900 and got["b", 950] == 950


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).isEmpty()


def labelled(spark, x, label):
    rows = [(i, [float(v) for v in p], int(c)) for i, (p, c) in enumerate(zip(x, label))]
    return spark.createDataFrame(rows, "id long, vector array<double>, label long")


@pytest.mark.parametrize("block_rows", [4096, 40])
def test_validity_indices(spark, block_rows):
    label, _ = brute.dbscan(POINTS, 0.35, 4, "l2")
    label[-1] = 99  # a cluster of one point
    points = labelled(spark, POINTS, label)
    got = validity.silhouette(points, block_rows=block_rows).first()[0]
    assert got == pytest.approx(brute.silhouette(POINTS, label), abs=1e-7)
    got = validity.davies_bouldin(points, block_rows=block_rows).first()[0]
    assert got == pytest.approx(brute.davies_bouldin(POINTS, label), abs=1e-7)
    got = validity.calinski_harabasz(points).first()[0]
    assert got == pytest.approx(brute.calinski_harabasz(POINTS, label), rel=1e-7)


@pytest.mark.parametrize("label", [[-1, -1, -1, -1], [0, 0, 0, 0], [0, 1, 2, 3]])
def test_validity_is_null_when_undefined(spark, label):
    points = labelled(spark, POINTS[:4], label)
    for index in (validity.silhouette, validity.davies_bouldin, validity.calinski_harabasz):
        assert [r[0] for r in index(points).collect()] == [None]


def test_weighted_silhouette_equals_copies(spark):
    label, _ = brute.dbscan(POINTS, 0.35, 4, "l2")
    distinct, first, count = np.unique(POINTS, axis=0, return_index=True, return_counts=True)
    points = labelled(spark, distinct, label[first])
    weights = spark.createDataFrame([(i, float(c)) for i, c in enumerate(count)], "id long, weight double")
    got = validity.silhouette(points.join(weights, "id")).first()[0]
    assert got == pytest.approx(brute.silhouette(POINTS, label), abs=1e-7)


def test_grid(spark):
    eps_list, densities = [0.1, 0.3, 0.45], [2, 5]
    rows = grid.dbscan_grid(frame(spark, POINTS), eps_list, densities, n_blocks=3).collect()
    assert len(rows) == 6
    for r in rows:
        label, _ = brute.dbscan(POINTS, r["eps"], r["min_samples"], "l2")
        assert r["num_clusters"] == label.max() + 1 and r["noise_count"] == (label == -1).sum()
        assert r["noise_pct"] == pytest.approx((label == -1).mean() * 100)
        for name in ("silhouette", "davies_bouldin"):
            want = getattr(brute, name)(POINTS, label)
            assert r[name] == (None if want is None else pytest.approx(want, abs=1e-6))


def test_default_grid_values():
    assert len(grid.GRID_EPS) == 12 and len(grid.GRID_MIN_SAMPLES) == 7
    assert grid.GRID_EPS[9] == pytest.approx(0.418182, abs=1e-6)


def test_pivot_and_best(spark):
    rows = [(0.1, 2, 3, 4, 5.0, 0.5, 2.0), (0.2, 2, 3, 4, 5.0, None, None), (0.1, 5, 3, 4, 5.0, 0.7, 1.0)]
    table = spark.createDataFrame(rows, "eps double, min_samples int, num_clusters long, noise_count long, noise_pct double, silhouette double, davies_bouldin double")
    assert [r["silhouette"] for r in grid.best_configs(table, "silhouette").collect()] == [0.7, 0.5]
    assert [r["davies_bouldin"] for r in grid.best_configs(table, "davies_bouldin").collect()] == [1.0, 2.0]
    pivot = grid.metric_pivot(table, "silhouette")
    assert pivot.columns == ["min_samples", "0.1", "0.2"]
    assert [tuple(r) for r in pivot.collect()] == [(2, 0.5, None), (5, 0.7, None)]


def test_diagnostics(spark):
    labels = spark.createDataFrame([(c,) for c in [0] * 5 + [1] * 2 + [2] * 3 + [3] * 4 + [-1] * 6], "label long")
    d = validity.cluster_diagnostics(labels).first()
    assert (d["total_points"], d["num_clusters"], d["noise_points"]) == (20, 4, 6)
    assert (d["noise_percentage"], d["avg_cluster_size"], d["median_cluster_size"]) == (30.0, 3.5, 3.5)
    assert (d["min_cluster_size"], d["max_cluster_size"]) == (2, 5)
    assert [tuple(r) for r in validity.largest_clusters(labels, 2).collect()] == [(0, 5), (3, 4)]
    empty = validity.cluster_diagnostics(labels.limit(0)).first()
    assert set(empty.asDict().values()) == {0}
    noise = validity.cluster_diagnostics(labels.filter("label = -1")).first()
    assert (noise["noise_points"], noise["noise_percentage"], noise["median_cluster_size"]) == (6, 100.0, 0)


def test_histogram_like_numpy(spark):
    sizes = [3, 3, 4, 9, 20, 20, 33]
    labels = spark.createDataFrame([(i,) for i, s in enumerate(sizes) for _ in range(s)], "label long")
    count, edges = np.histogram(sizes, bins=30)
    got = {r["bin"]: r for r in validity.size_histogram(labels).collect()}
    assert {b - 1: r["n_clusters"] for b, r in got.items()} == {i: c for i, c in enumerate(count) if c}
    assert all(r["from_size"] == pytest.approx(edges[b - 1]) for b, r in got.items())
    same = validity.size_histogram(spark.createDataFrame([(0,), (1,)], "label long")).collect()
    want = np.flatnonzero(np.histogram([1, 1], bins=30)[0])
    assert [r["bin"] - 1 for r in same] == want.tolist()


@pytest.mark.parametrize("n", [254, 255, 300])
def test_forests_with_many_radii(n):
    from mediatrends.operators.dbscan import _Forests

    forest = _Forests(3, n)
    forest.add(np.array([0, 1]), np.array([1, 0]), np.array([n - 1, n - 1]))
    assert [root.tolist() for root in forest.roots] == [[0, 1, 2]] * (n - 1) + [[0, 0, 2]]


def test_forests_equal_components_at_every_level():
    from mediatrends.operators.dbscan import _Forests

    draw = np.random.default_rng(1)
    for _ in range(20):
        n, m, limit = 60, 150, 5
        u, v, level = draw.integers(n, size=m), draw.integers(n, size=m), draw.integers(limit, size=m)
        forest = _Forests(n, limit)
        for part in np.array_split(np.arange(m), 4):
            forest.add(u[part], v[part], level[part])
        for at in range(limit):
            root = list(range(n))
            for a, b in zip(u[level <= at].tolist(), v[level <= at].tolist()):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
            assert forest.roots[at].tolist() == root


@pytest.mark.parametrize("metric, reach, least", [("cosine", 0.418182, 0.95), ("cosine", 0.05, 0.99), ("l2", 0.5, 0.99)])
def test_first_coordinates_rule_out_most_distances(embeddings, metric, reach, least):
    from mediatrends.operators import blocks

    x = np.array([r["embedding"] for r in embeddings.collect()])
    x = np.concatenate([x, x[:40] + rng.normal(scale=0.02, size=(40, x.shape[1]))])
    bound = blocks._Prefix(x, x, metric, reach)
    left = bound.candidates(slice(0, len(x)))
    true = blocks.pairwise(x, x, metric) <= reach
    assert 0 < bound.width < x.shape[1] and not (true & ~left).any() and true.sum() > len(x)
    assert 1 - left.mean() >= least  # the share of distances that are never computed


@pytest.mark.parametrize("metric, reach", [("cosine", 0.3), ("cosine", 1.2), ("l2", 0.4), ("l2", 3.0)])
def test_close_steps_equal_all_distances(metric, reach):
    import pyarrow as pa

    from mediatrends.operators import blocks

    def side(rows):
        return blocks.Side(pa.table({"row": pa.array(np.arange(len(rows))), "vector": pa.array(rows.tolist(), pa.list_(pa.float64()))}))

    a, b = side(POINTS[:150]), side(POINTS[150:])
    for left, right in ((a, b), (b, a), (a, a)):
        d = blocks.pairwise(left.vectors, right.vectors, metric)
        if left is right:
            np.fill_diagonal(d, 0.0)
        got = [(i, j) for x, y, _ in blocks.close_steps(left, right, metric, reach) for i, j in zip(x.tolist(), y.tolist())]
        assert sorted(got) == sorted(zip(*(v.tolist() for v in np.nonzero(d <= reach))))


@pytest.mark.parametrize("metric, eps_list", [("cosine", [0.1, 0.3, 1.2]), ("l2", [1.0, 1.3, 1.6])])
def test_close_levels_equal_all_distances(monkeypatch, metric, eps_list):
    """The first radius that covers a pair, at the price of a few distances in double."""
    import pyarrow as pa

    from mediatrends.operators import blocks

    x = np.random.default_rng(17).normal(size=(400, 16)) / 4
    x[200:210] = x[:10]
    x[11] = 0.0

    def side(rows):
        return blocks.Side(pa.table({"row": pa.array(np.arange(len(rows))), "vector": pa.array(rows.tolist(), pa.list_(pa.float64()))}))

    computed, plain = [], blocks._Prefix.distances
    monkeypatch.setattr(blocks._Prefix, "distances", lambda self, i, j: computed.append(len(i)) or plain(self, i, j))
    a, b = side(x[:200]), side(x[200:])
    for left, right in ((a, b), (b, a), (a, a)):
        d = blocks.pairwise(left.vectors, right.vectors, metric)
        if left is right:
            np.fill_diagonal(d, 0.0)
        want = np.searchsorted(eps_list, d)
        got = {(i, j): l for x, y, z in blocks.close_levels(left, right, metric, eps_list) for i, j, l in zip(x.tolist(), y.tolist(), z.tolist())}
        assert got == {(i, j): want[i, j] for i, j in zip(*(v.tolist() for v in np.nonzero(want < len(eps_list))))}
    assert 0 < sum(computed) < 0.02 * 3 * 200 * 200


@pytest.mark.parametrize("kind", [int, str])
def test_silhouette_block_finds_its_own_rows(kind):
    """Rows are looked up in the block, not compared with each of it; repeated ones are all found."""
    import pyarrow as pa

    held = [kind(i) for i in (5, 3, 9, 3, 7)]
    columns = validity._Columns(pa.table({"row": held, "vector": [[1.0, float(i)] for i in range(5)], "label": [0, 1, 0, 1, 1], "size": [2.0, 3.0, 2.0, 3.0, 3.0], "weight": [1.0] * 5, "whole": [True] * 5}))
    asked = np.array([kind(i) for i in (3, 4, 9)], dtype=object if kind is str else None)
    row, place = columns.same(asked)
    assert sorted(zip(row.tolist(), columns.rows[place].tolist())) == [(0, kind(3)), (0, kind(3)), (2, kind(9))]


def test_joined_points_do_not_meet_again(spark, monkeypatch):
    """Points of one large cluster are joined by few pairs of blocks; all others still meet every point."""
    from mediatrends.operators import dbscan as module

    draw = np.random.default_rng(23)
    x = np.concatenate([draw.normal(scale=0.3, size=(500, 2)), draw.normal(scale=0.3, size=(60, 2)) + 6, draw.uniform(-4, 9, size=(60, 2))])
    order = draw.permutation(len(x))
    x, eps_list, settings, sent = x[order], [0.2, 0.35, 0.8], [2, 4, 9], []
    plain = module.tile_pairs

    def counted(left, right, *more):
        sent.append((left.count(), right.count()))
        return plain(left, right, *more)

    monkeypatch.setattr(module, "tile_pairs", counted)
    got = grid.dbscan_grid(frame(spark, x), eps_list, settings, "l2", n_blocks=12).collect()
    assert len(got) == 9 and len(sent) == 2 and all(0 < left < 0.5 * right for left, right in sent)
    for r in got:
        label, _ = brute.dbscan(x, r["eps"], r["min_samples"], "l2")
        assert (r["num_clusters"], r["noise_count"]) == (label.max() + 1, (label < 0).sum())
    assert len({(r["num_clusters"], r["noise_count"]) for r in got}) > 5
    for eps, m in ((0.35, 4), (0.8, 9)):
        label, _ = brute.dbscan(x, eps, m, "l2")
        found = dbscan(frame(spark, x), eps, m, "l2", n_blocks=12).orderBy("id").collect()
        assert [r["label"] for r in found] == label.tolist()


def test_points_go_to_neighbouring_cells_only(spark):
    """A line of clouds: a point is copied to its own cell and to the cell before, however many cells there are."""
    cloud = np.concatenate([np.array([10.0 * c, 0.0]) + rng.normal(scale=0.5, size=(30, 2)) for c in range(40)])
    rows = frame(spark, cloud).select(F.col("id").alias("row"), F.col("embedding").alias("vector"))
    blocks = block_pairs(rows, "l2", 1.0, block_rows=200, n_blocks=160, prune=True)
    copies = blocks._tiles(blocks.points).groupBy("row").count().collect()
    assert len(copies) == len(cloud)
    # cells of one cloud are neighbours of each other; those of other clouds are none
    pivots = blocks.n_blocks / 40
    assert max(r["count"] for r in copies) <= 4 * pivots and sum(r["count"] for r in copies) <= 2.5 * pivots * len(cloud)
    met = blocks._tiles(blocks.points).select("tile", F.floor(F.col("row") / 30).alias("cloud")).distinct().groupBy("tile").count()
    assert met.agg(F.max("count")).first()[0] == 1


@pytest.mark.parametrize("block_rows, copies", [(4096, 16), (40, 2)])
def test_silhouette_sends_resident_blocks_once(spark, monkeypatch, block_rows, copies):
    label, _ = brute.dbscan(POINTS, 0.35, 4, "l2")
    n, sent = int((label >= 0).sum()), {}
    plain = validity._exchange

    def counted(resident, streamed, *more):
        for name, df in (("resident", resident), ("streamed", streamed)):
            sent[name] = df.agg(F.count(F.lit(1)), F.sum(F.size("vector") * 8), F.countDistinct("right_block"), F.countDistinct("left_block")).first()
        return plain(resident, streamed, *more)

    monkeypatch.setattr(validity, "_exchange", counted)
    got = validity.silhouette(labelled(spark, POINTS, label), block_rows=block_rows).first()[0]
    assert got == pytest.approx(brute.silhouette(POINTS, label), abs=1e-7)
    blocks = sent["streamed"][2]
    # resident blocks go to as many tasks as it takes to keep the cores busy, streamed rows pass each block once
    assert sent["streamed"][:2] == (n * blocks, n * blocks * 48)
    assert sent["resident"][3] <= max(1, min(copies, -(-n // validity.STEP))) and sent["resident"][:2] == (n * sent["resident"][3], n * sent["resident"][3] * 48)


def test_blocks_are_sized_by_bytes(spark):
    wide = spark.createDataFrame([(1, [0.0] * 1536)], "id long, vector array<double>")
    assert validity._rows_of(wide) == (8 << 20) // (8 * 1536) and validity._rows_of(frame(spark, POINTS).withColumnRenamed("embedding", "vector")) == 4096


@pytest.mark.parametrize("options", [{}, {"n_blocks": 3}, {"n_blocks": 5, "prune": True, "block_rows": 20}])
@pytest.mark.parametrize("metric, eps", [("cosine", 0.02), ("l2", 0.3)])
def test_linked_tells_class_and_links(spark, metric, eps, options):
    from mediatrends.operators.dbscan import linked

    near = brute.distances(POINTS, metric) <= eps
    np.fill_diagonal(near, False)
    label, _ = brute.dbscan(POINTS, eps, 1, metric)
    least = {c: int(np.flatnonzero(label == c)[0]) for c in set(label.tolist())}
    got = {r["id"]: (r["component_id"], r["n_links"]) for r in linked(frame(spark, POINTS), eps, metric, **options).collect()}
    assert got == {i: (least[label[i]], int(near[i].sum())) for i in range(len(POINTS))}


def test_blocks_grow_with_the_table(spark):
    """A row meets every block, so small blocks must not make their number follow the rows."""
    from mediatrends.operators import blocks

    rows = frame(spark, rng.normal(size=(3000, 16))).select(F.col("id").alias("row"), F.col("embedding").alias("vector"))
    for prune in (False, True, None):
        made = block_pairs(rows, "cosine", 0.65, block_rows=8, n_blocks=12, prune=prune)
        copies = made._tiles(made.points).groupBy("row").count()
        assert copies.agg(F.sum("count")).first()[0] <= 2 * blocks.BLOCKS * 3000
    # vectors without clusters are not cut into cells, since every cell would meet all others
    made = block_pairs(rows, "cosine", 0.9, block_rows=100, n_blocks=30)
    assert made.n_tiles is None and made.n_blocks == 30


def test_silhouette_blocks_grow_with_the_table(spark, monkeypatch):
    """Every row passes every block: small blocks must not make their number follow the rows."""
    x = rng.normal(size=(1500, 3)) + 8 * np.eye(3)[np.arange(1500) % 3]
    label, sent, plain = np.arange(1500) % 3, [], validity._exchange

    def counted(resident, streamed, *more):
        sent.append(streamed.select("right_block").distinct().count())
        return plain(resident, streamed, *more)

    monkeypatch.setattr(validity, "_exchange", counted)
    got = validity.silhouette(labelled(spark, x, label), block_rows=8).first()[0]
    assert got == pytest.approx(brute.silhouette(x, label), abs=1e-7) and sent[0] <= validity.BLOCKS + 3


def side_of(x, **columns):
    import pyarrow as pa

    from mediatrends.operators.blocks import Side

    return Side(pa.table({"row": np.arange(len(x)), "vector": pa.array(x.tolist(), pa.list_(pa.float64())), **columns}))


def test_forests_send_one_edge_a_point_and_density():
    from mediatrends.operators.dbscan import _core_forest

    eps_list = [0.1, 0.2, 0.3, 0.4, 0.6]
    d = brute.distances(POINTS, "l2")
    core = [np.array([next((i for i, e in enumerate(eps_list) if (row <= e).sum() >= m), 5) for row in d]) for m in (2, 5)]
    side = side_of(POINTS, core0=core[0], core1=core[1])
    kernel, _ = _core_forest("l2", eps_list, 2)
    sent = [(s, at, u, v) for found in kernel(side, side) for s, at, u, v in zip(*(found[c].tolist() for c in ("setting", "level", "src", "dst")))]
    assert len({(s, u) for s, _, u, _ in sent}) == len(sent) < 2 * len(POINTS)
    for s, m in enumerate((2, 5)):
        for level, eps in enumerate(eps_list):
            root = list(range(len(POINTS)))
            for _, _, u, v in sorted(e for e in sent if e[0] == s and e[1] <= level):
                root = [root[v] if r == root[u] else r for r in root]
            label, is_core = brute.dbscan(POINTS, eps, m, "l2")
            at = np.flatnonzero(is_core)
            assert len({(root[i], label[i]) for i in at}) == len({root[i] for i in at}) == len({label[i] for i in at})


def test_borders_are_looked_for_where_points_are_not_core(monkeypatch):
    import pyarrow as pa

    from mediatrends.operators import dbscan as module

    eps_list, none = [0.1, 0.2, 0.5], int(module.NO_CLUSTER)
    x = np.array([[0.0], [0.15], [0.35]])
    # row 1 is not core at the first two radii, row 2 at the first only
    roots = [[0, 0, 0], [none, none, 0], [none, 2, 0]]
    side, reach = side_of(x, roots=pa.array(roots, pa.list_(pa.int64()))), []
    steps = module.close_steps
    monkeypatch.setattr(module, "close_steps", lambda a, b, metric, most: reach.append(most) or steps(a, b, metric, most))
    kernel, _ = module._border_roots("l2", eps_list, [0, 1, 2])
    found = [r for f in kernel(side, side) for r in zip(*(f[c].tolist() for c in ("config", "row", "root")))]
    assert found == [(1, 1, 0)] and reach == [0.2]


def test_blocks_of_many_clusterings_grow(spark):
    rows = [(k, i, [float(i)]) for k, n in ((0, 100), (1, 7)) for i in range(n)]
    points = spark.createDataFrame(rows, "config int, row long, vector array<double>")
    assert validity._grown(points, 2, ["config"]) == 13 and validity._grown(points, 50, ["config"]) == 50
