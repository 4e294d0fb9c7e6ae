import random

import pytest

from mediatrends.llm.suffix_dedup import COVERS, cover_period, remove_repeats
from tests.conftest import SF
from tests.llm import plain

SCHEMA = "doc_id long, text string"


def found(df, **options):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(df, **options).collect()}


def test_every_difference_occurs_once():
    for period, cover in COVERS.items():
        assert len({(a - b) % period for a in cover for b in cover}) == period
        assert len(cover) * (len(cover) - 1) == period - 1


def test_period_leaves_a_third():
    assert cover_period(200) == 133
    with pytest.raises(ValueError):
        cover_period(5)


@pytest.mark.parametrize("n, seed", [(11, 1), (24, 2), (60, 3)])
def test_equals_plain_version(spark, n, seed):
    draw = random.Random(seed)
    base = ["".join(draw.choice("abcé") for _ in range(draw.choice([0, 5, 30, 200, 700]))) for _ in range(8)]
    rows = []
    for i in range(100):
        text = ""
        for _ in range(draw.randint(0, 4)):
            piece, at = draw.choice(base), draw.randint(0, 100)
            text += piece[at : at + draw.randint(0, 300)] + "".join(draw.choice("xyz") for _ in range(draw.randint(0, 9)))
        rows.append((i, text if i % 17 else None))
    want = dict(zip([i for i, _ in rows], plain.repeats([t for _, t in rows], n)))
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(4), min_bytes=n, chunk_bytes=500) == want


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    want = dict(zip([r.doc_id for r in rows], plain.repeats([r.text for r in rows], 200)))
    assert found(docs, chunk_bytes=60_000) == want


def test_repeats_within_a_text_and_overlaps(spark):
    rows = [(1, "a" * 300), (2, "b" * 199), (3, "c" * 200), (4, "d" * 201)]
    got = found(spark.createDataFrame(rows, SCHEMA))
    assert [got[i][1] for i in (1, 2, 3, 4)] == [300, 0, 0, 201]


def test_repeated_rows_null_ids_clashing_columns_and_texts(spark):
    text = "".join(chr(97 + i * i % 23) for i in range(250))
    rows = [(None, text, 1, "x"), (None, text, 1, "x"), (3, None, 2, None), (3, "", 2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, chunk int, id string")
    got = remove_repeats(df, texts=True).collect()
    assert sorted((r.doc_id or 0, r.n_removed, r.kept_text) for r in got) == [(0, 250, ""), (0, 250, ""), (3, 0, ""), (3, 0, "")]


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_document_is_a_chunk(spark):
    draw = random.Random(5)
    long_ = "".join(draw.choice("abcdefgh") for _ in range(200_000))
    got = found(spark.createDataFrame([(1, long_), (2, "x" + long_[1000:1300] + "y")], SCHEMA), chunk_bytes=10_000)
    assert got[1][1:3] == (300, 1) and got[2][1:3] == (300, 1)


def test_chunks_are_written_in_small_groups(spark, monkeypatch):
    """A task writes and reads a few chunks at a time, however many it has."""
    import glob
    import random

    import pyarrow.parquet as pq

    from mediatrends.llm import suffix_dedup

    groups, plain = [], suffix_dedup.materialize

    def written(df, name):
        table = plain(df, name)
        if name == "chunks":
            for path in glob.glob(f"{table.scratch_path}/*.parquet"):
                info = pq.ParquetFile(path).metadata
                groups.extend(info.row_group(i).num_rows for i in range(info.num_row_groups))
        return table

    monkeypatch.setattr(suffix_dedup, "materialize", written)
    draw = random.Random(3)
    rows = [(i, draw.randbytes(500_000).hex()) for i in range(45)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = suffix_dedup.remove_repeats(docs, chunk_bytes=1 << 20)
    assert found.agg({"n_removed": "sum"}).first()[0] == 0 and found.count() == 45
    assert sum(groups) == 45 and max(groups) <= 36
