import math

import numpy as np
import pytest

from mediatrends.llm import whitening
from mediatrends.llm.whitening import whiten
from tests.conftest import SF

SCHEMA = "vec_id long, embedding array<float>"


def plain(vectors, k=32):
    """Deviations, coordinates and shares, by numpy on whole numbers."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    off = [[n * a - s for a, s in zip(row, sums)] for row in x]
    centred = np.array(off, float) / n
    cov = centred.T @ centred / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    k = min(k, int((e > 1e-12 * e[0]).sum()))
    return [sum(a * a for a in row) for row in off], centred @ v[:, :k] / np.sqrt(e[:k]), e[:k] / np.trace(cov)


def compare(got, vectors, ids):
    deviation, white, shares = plain(vectors)
    k = white.shape[1]
    table = {}
    for r in got:
        table.setdefault((r.vec_id, r.deviation), {})[r.component] = r
    assert len(got) == len(ids) * k and {c for t in table.values() for c in t} == set(range(1, k + 1))
    for i, d, w in zip(ids, deviation, white):
        mine = [table[i, d][c] for c in range(1, k + 1)]
        assert np.allclose(np.abs([r.whitened for r in mine]), np.abs(w), rtol=1e-6, atol=1e-7)
        assert np.allclose([r.explained for r in mine], shares, rtol=1e-9)
        assert all(r.n == len(ids) and 0 <= r.identity_error < 1e-6 for r in mine)
    signs = np.array([[table[i, d][c].whitened for c in range(1, k + 1)] for i, d in zip(ids, deviation)]) / white
    assert np.allclose(np.sign(signs), np.sign(signs[0]))  # a component has one sign for all rows


@pytest.mark.parametrize("block_bytes", [1 << 21, 8 * 64 * 20])
def test_given_vectors(spark, embeddings, monkeypatch, block_bytes):
    monkeypatch.setattr(whitening, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(whitening, "BLOCKS_A_TASK", 3)
    rows = embeddings.collect()
    compare(whiten(embeddings).collect(), [r.embedding for r in rows], [r.vec_id for r in rows])


def test_unusable_vectors_and_clashing_columns(spark):
    draw = np.random.default_rng(1)
    good = draw.normal(size=(30, 5)).tolist()
    good = [[float(np.float32(c)) for c in v] for v in good]
    bad = [None, [], [1.0, None, 0.0, 0.0, 0.0], [float("nan")] * 5, [float("inf"), 0.0, 0.0, 0.0, 0.0], [1.0, 2.0]]
    rows = [(i, v, 0, 1.0) for i, v in enumerate(good + bad)]
    docs = spark.createDataFrame(rows, SCHEMA + ", row int, values double")
    compare(whiten(docs).collect(), good, list(range(30)))


def test_ties_repeats_and_null_ids(spark):
    vectors = [[0.0, 1.0, 2.0], [1.0, 0.0, 2.0], [0.0, 1.0, 2.0], [0.0, 1.0, 2.0]]
    got = whiten(spark.createDataFrame([(None, vectors[0]), (1, vectors[1]), (None, vectors[2]), (2, vectors[3])], SCHEMA)).collect()
    # three equal vectors and another one span a line
    assert sorted((str(r.vec_id), r.component, r.n) for r in got) == [("1", 1, 4), ("2", 1, 4), ("None", 1, 4), ("None", 1, 4)]
    assert all(abs(r.explained - 1) < 1e-12 and r.identity_error < 1e-12 for r in got)


def test_no_variance_and_empty_tables(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], SCHEMA)
    for given in (one, one.limit(1), one.limit(0), spark.createDataFrame([(1, None)], SCHEMA)):
        got = whiten(given)
        assert got.collect() == []
        assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_large_entries_stay_exact(spark):
    vectors = [[4000.5, -4000.25], [-4000.75, 3999.0], [0.0, 0.25]]
    compare(whiten(spark.createDataFrame(list(enumerate(vectors)), SCHEMA)).collect(), vectors, [0, 1, 2])


def test_dealt_query_reads_the_whole_table(spark):
    from mediatrends.llm.registry import queries

    assert queries()["op12_whitening"](spark, SF).select("vec_id").distinct().count() == spark.read.parquet(f"{SF}/embeddings.parquet").count()
