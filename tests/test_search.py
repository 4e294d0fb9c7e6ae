import math

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from mediatrends.functions import vectors as V
from mediatrends.operators import ivf, search

rng = np.random.default_rng(8)


@pytest.fixture(scope="module")
def segments(spark):
    x = rng.normal(size=(300, 5)).round(2)
    x[100:200] = x[100]  # a third of all vectors are copies
    x[250] = 0.0
    rows = [(f"s{i:03d}", f"v{i % 7}", float(i), i + 1.0, f"text {i}", [float(v) for v in p]) for i, p in enumerate(x)]
    schema = "id string, video_id string, segment_start_time double, segment_end_time double, segment_text string, segment_embedding array<float>"
    return spark.createDataFrame(rows + [("none", "v0", 0.0, 1.0, "", None)], schema).cache()


@pytest.fixture(scope="module")
def queries(segments):
    return segments.filter("segment_embedding IS NOT NULL").select(F.col("id").alias("query_id"), F.col("segment_embedding").alias("embedding"))


def expected(segments, k, metric, rank_by):
    rows = sorted((r for r in segments.collect() if r["segment_embedding"]), key=lambda r: r["id"])
    x = np.array([r["segment_embedding"] for r in rows])
    shown, rank = brute.distances(x, metric), brute.distances(x, rank_by)
    zero = ~x.any(axis=1)
    for d, name in ((shown, metric), (rank, rank_by)):
        if name == "cosine":
            d[zero, :] = d[:, zero] = np.nan
    out = {}
    for q in range(len(x)):
        order = np.lexsort((np.arange(len(x)), np.where(np.isnan(rank[q]), np.inf, rank[q].round(9))))[:k]
        out[rows[q]["id"]] = [(rows[j]["id"], shown[q, j]) for j in order]
    return out


@pytest.mark.parametrize("metric, rank_by", [("cosine", None), ("l2", None), ("l2", "cosine")])
@pytest.mark.parametrize("options", [{}, {"ship_limit": 0, "block_rows": 64}])
def test_knn_join(segments, queries, metric, rank_by, options):
    k = 12
    got = {}
    for r in search.knn_join(queries, segments, k, metric, rank_by, **options).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["segment_id"], r["distance"]))
    want = expected(segments, k, metric, rank_by or metric)
    assert got.keys() == want.keys()
    for q, hits in got.items():
        hits.sort()
        assert [h[0] for h in hits] == list(range(1, k + 1))
        for (_, _, d), (_, e) in zip(hits, want[q]):
            assert (math.isnan(d) and math.isnan(e)) or d == pytest.approx(e, abs=6e-5)
        if rank_by is None:
            copies = [s for _, s, _ in hits if 100 <= int(s[1:]) < 200]
            assert copies == sorted(copies)


def test_many_queries_in_steps(segments, queries, monkeypatch):
    run = lambda **options: sorted(map(str, search.knn_join(queries, segments, 5, **options).collect()))
    exact = run()
    monkeypatch.setattr(search, "QUERY_STEP", 7)
    assert run() == exact and run(ship_limit=0, block_rows=90) == exact


@pytest.mark.parametrize("kind", [int, str])
def test_hits_are_merged_a_few_times(monkeypatch, kind):
    """Many batches of segments: found hits wait until there are as many as are kept."""
    draw = np.random.default_rng(31)
    x, k, calls, plain = draw.integers(0, 4, size=(2000, 3)).astype(float), 10, [], search._best
    ids = np.array([kind(i) for i in draw.permutation(len(x))])
    monkeypatch.setattr(search, "_best", lambda *a: calls.append(len(a[0])) or plain(*a))
    ((query, rank, _, found),) = search._nearest(x[:20], ((ids[i : i + 20], x[i : i + 20]) for i in range(0, len(x), 20)), k, "l2", "l2")
    d = V.pairwise(x[:20], x, "l2")
    for q in range(20):
        want = np.lexsort((ids, d[q]))[:k]
        assert found[query == q].tolist() == ids[want].tolist() and rank[query == q].tolist() == d[q][want].tolist()
    assert len(calls) <= 30  # of 100 batches


def test_single_query_equals_join(segments, queries):
    vector = queries.filter("query_id = 's003'").first()["embedding"]
    one = search.knn(segments, vector, 20)
    many = search.knn_join(queries.filter("query_id = 's003'"), segments, 20)
    assert [r["id"] for r in one.collect()] == [r["segment_id"] for r in many.orderBy("rank").collect()]
    assert [r["distance"] for r in one.collect()][0] == 0.0


def test_arguments(segments):
    with pytest.raises(ValueError):
        search.knn(segments, [1.0], 0)
    with pytest.raises(ValueError):
        search.knn(segments, [], 5)
    with pytest.raises(ValueError):
        search.knn(segments, [1.0], 5, "dot")
    with pytest.raises(Exception, match="differ in width"):
        search.knn(segments, [1.0], 5).collect()


def test_ivf_with_all_probes_is_exact(segments, queries):
    model = ivf.ivf_train(segments, lists=8)
    cells = ivf.ivf_assign(segments, model).cache()
    assert cells.count() == 300 and cells.filter("cell = -1").count() == 1
    exact = search.knn_join(queries, segments, 10).collect()
    found = ivf.ivf_search(queries, cells, model, 10, probes=8, block_rows=50).collect()
    key = lambda r: (r["query_id"], r["rank"])
    assert [r["distance"] for r in sorted(found, key=key) if not math.isnan(r["distance"])] == [
        r["distance"] for r in sorted(exact, key=key) if not math.isnan(r["distance"])
    ]
    few = {(r["query_id"], r["segment_id"]) for r in ivf.ivf_search(queries, cells, model, 10, probes=2).collect()}
    all_hits = {(r["query_id"], r["segment_id"]) for r in exact}
    assert 0.5 < len(few & all_hits) / len(all_hits) <= 1


def test_grouping(segments, queries):
    hits = search.knn_join(queries.filter("query_id = 's005'"), segments, 30)
    groups = search.group_segments(search.attach_segments(hits, segments), ["query_id"]).orderBy("best_rank").collect()
    assert sum(len(g["segments"]) for g in groups) == 30
    assert groups[0]["best_rank"] == 1 and groups[0]["video_id"] == "v5"
    for g in groups:
        d = [s["distance"] for s in g["segments"]]
        assert d == sorted(d)
        assert set(g["segments"][0].asDict()) == {"segment_text", "segment_start_time", "segment_end_time", "distance"}


def test_vector_columns(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0])], "a array<double>, b array<float>, z array<double>")
    row = df.select(
        V.cosine_distance(F.col("a"), F.col("b")).alias("cos"),
        V.l2_distance(F.col("a"), F.col("b")).alias("l2"),
        V.cosine_distance(F.col("a"), F.col("a")).alias("same"),
        V.cosine_distance(F.col("a"), F.col("z")).alias("nan"),
        V.cosine_distance(F.col("a"), F.col("z"), "one").alias("one"),
        V.normalize_vector(F.col("a")).alias("unit"),
        V.normalize_vector(F.col("z")).alias("zero"),
        V.rowwise("cosine")("a", "b").alias("bulk_cos"),
        V.rowwise("l2")("a", "b").alias("bulk_l2"),
    ).first()
    assert row["cos"] == pytest.approx(0.04) and row["l2"] == pytest.approx(math.sqrt(2)) and row["same"] == 0
    assert math.isnan(row["nan"]) and row["one"] == 1.0
    assert row["unit"] == [0.6, 0.8] and row["zero"] == [0.0, 0.0]
    assert row["bulk_cos"] == pytest.approx(row["cos"]) and row["bulk_l2"] == pytest.approx(row["l2"])
    for f in (V.cosine_distance, V.l2_distance):
        with pytest.raises(Exception, match="differ in width"):
            df.select(f(F.col("a"), F.slice("b", 1, 1))).collect()
    with pytest.raises(Exception, match="expected 3 dimensions"):
        df.select(V.check_dim(F.col("b"), 3)).collect()
    assert df.select(V.check_dim(F.col("b"), 2)).first()[0] == [4.0, 3.0]


def test_unnest(spark):
    nested = spark.createDataFrame([(1, [[1.0, 2.0]]), (2, []), (3, None)], "i int, e array<array<double>>")
    assert [r["e"] for r in V.unnest_vector(nested, "e").orderBy("i").collect()] == [[1.0, 2.0], [], None]
    flat = spark.createDataFrame([([1.0],)], "e array<double>")
    assert V.unnest_vector(flat, "e").schema["e"].dataType.simpleString() == "array<float>"


def test_ivf_reads_only_visited_cells(spark, tmp_path, monkeypatch):
    from mediatrends.operators import ivf
    from mediatrends.sources import writers

    draw = np.random.default_rng(3)
    rows = [(f"s{i}", "v", 0.0, 1.0, "t", draw.normal(size=8).tolist()) for i in range(200)]
    segments = spark.createDataFrame(rows, "id string, video_id string, segment_start_time double, segment_end_time double, segment_text string, segment_embedding array<double>")
    model = ivf.ivf_train(segments, lists=8)
    writers.write_cells(ivf.ivf_assign(segments, model), str(tmp_path / "cells"))
    stored = spark.read.parquet(str(tmp_path / "cells"))
    queries = spark.createDataFrame([("q", rows[0][5])], "query_id string, embedding array<double>")
    plans, grid = [], ivf._grid_hits
    monkeypatch.setattr(ivf, "_grid_hits", lambda left, right, *more: plans.append(right._jdf.queryExecution().toString()) or grid(left, right, *more))
    hits = ivf.ivf_search(queries, stored, model, k=5, probes=1)
    assert hits.filter("rank = 1").first()["segment_id"] == "s0"
    pruned = [p.split("]")[0] for plan in plans for p in plan.split("PartitionFilters: [")[1:]]
    assert plans and len(pruned) >= len(plans) and all("cell#" in p for p in pruned), pruned
    exact = ivf.ivf_search(queries, stored, model, k=5, probes=8)
    assert {r["segment_id"] for r in hits.collect()} <= {r[0] for r in rows} and exact.count() == 5


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_registered_ivf_search_has_its_recall(spark, sf):
    import __spark_entry__ as entry
    from tests.conftest import SF

    folder = SF.replace("sf0.001", sf)
    pairs = lambda name: {(r["query_id"], r["segment_id"]) for r in entry.queries()[name](spark, folder).collect()}
    exact, found = pairs("knn_join"), pairs("ivf_search")
    recall = len(found & exact) / len(exact)
    print(f"{sf}: recall {recall:.4f} of {len(exact)} hits")
    assert recall >= 0.9


def test_probes_follow_the_data(spark):
    # three tight groups: the hits of a query lie in its own cell; k beyond a group needs more
    draw = np.random.default_rng(5)
    rows = [(i, (np.eye(8)[i % 3] + 0.01 * draw.normal(size=8)).tolist()) for i in range(90)] + [(90, [0.0] * 8)]
    segments = spark.createDataFrame(rows, "id int, segment_embedding array<double>")
    model = ivf.ivf_train(segments, lists=3)
    cells = ivf.ivf_assign(segments, model).cache()
    assert ivf.choose_probes(cells, model, k=10) == 1
    assert ivf.choose_probes(cells, model, k=91) == 3
    assert [ivf.lists_for(n) for n in (0, 500, 2000, 10**9)] == [2, 22, 45, 4096]


@pytest.mark.parametrize("clustered", [True, False])
def test_bounds_travel_from_round_to_round(spark, monkeypatch, clustered):
    draw = np.random.default_rng(7)
    centers = draw.normal(size=(20, 8)) * (4 if clustered else 0)
    rows = [(i, (centers[i % 20] + draw.normal(size=8)).tolist()) for i in range(4000)]
    segments = spark.createDataFrame(rows, "id int, segment_embedding array<double>")
    model = ivf.ivf_train(segments, lists=40)
    cells = ivf.ivf_assign(segments, model).cache()
    queries = spark.createDataFrame([(i, rows[i * 40][1]) for i in range(100)], "query_id int, embedding array<double>")
    merged, plain = [], ivf._round_hits

    def counted(hits, best):
        every = plain(hits, best).cache()
        merged.append((every.count(), best is None))
        return every

    monkeypatch.setattr(ivf, "_round_hits", counted)
    k = 20
    found = ivf.ivf_search(queries, cells, model, k, probes=40).collect()
    exact = search.knn_join(queries, segments, k).collect()
    assert {(r["query_id"], r["rank"], r["segment_id"]) for r in found} == {(r["query_id"], r["rank"], r["segment_id"]) for r in exact}
    assert len(merged) > 2 and [first for _, first in merged] == [True] + [False] * (len(merged) - 1)
    # without bounds all 40 cells would give their best k hits, 800 for each query
    assert max(n for n, _ in merged) <= (4 if clustered else 6) * k * 100
    assert sum(n for n, _ in merged) <= 12 * k * 100


def test_blocks_of_a_search_grow_with_their_cell(spark):
    """A query has k hits in every segment block: their number must not follow the rows."""
    draw = np.random.default_rng(11)
    rows = spark.createDataFrame([(i, draw.normal(size=4).tolist()) for i in range(1500)], "id int, vector array<double>")
    cell = F.lit(0).alias("cell")
    left, right = rows.select(F.col("id").alias("query_id"), "vector", cell), rows.select(F.col("id").alias("segment_id"), "vector", cell)
    hits, pairs = search._grid_hits(left, right, 5, "l2", "l2", block_rows=8)
    assert pairs <= search.QUERY_BLOCKS * search.SEGMENT_BLOCKS
    assert hits.count() <= 1500 * 5 * search.SEGMENT_BLOCKS


@pytest.mark.parametrize("name", ["knn_join", "knn_join_l2", "knn_join_blocked", "search_grouped", "ivf_search_all_cells", "ivf_search"])
def test_registered_searches_ask_every_row(spark, name, tmp_path):
    import __spark_entry__ as entry

    draw = np.random.default_rng(21)
    rows = [(i, draw.normal(size=4).tolist(), i % 3) for i in range(130)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    asked = {r["query_id"] for r in entry.queries()[name](spark, str(tmp_path)).select("query_id").distinct().collect()}
    assert asked == {i for i, _, _ in rows}
    sql = entry.oracle_sql().get(name)
    if sql:
        import duckdb

        db = duckdb.connect()
        db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
        assert {r[0] for r in db.execute(f"SELECT DISTINCT query_id FROM ({sql})").fetchall()} == asked
