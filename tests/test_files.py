import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from mediatrends.sources import files, readers


def test_listing_goes_level_by_level_in_tasks(spark, tmp_path, monkeypatch):
    for name, size in (("a.mp4", 3), ("x/b c.mp4", 5), ("x/y/z/none.mov", 0), ("x/_hidden/d.mp4", 1), (".h", 1), ("ü%20/e.mkv", 2)):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x" * size)
    (tmp_path / "nothing").mkdir()
    want = {(f"file:{tmp_path}/{n}", s) for n, s in (("a.mp4", 3), ("x/b c.mp4", 5), ("x/y/z/none.mov", 0), ("ü%20/e.mkv", 2))}
    got = readers.list_media(spark, str(tmp_path))
    assert got.columns == ["path", "size"] and {tuple(r) for r in got.collect()} == want
    # no path was collected: the listing is a scan of written tables
    assert all("/listing-" in p for p in got.inputFiles())
    assert {r["path"] for r in files.list_files(spark, [str(tmp_path / "x"), str(tmp_path / "a.mp4")], ".mp4").collect()} == {f"file:{tmp_path}/x/b c.mp4", f"file:{tmp_path}/a.mp4"}
    assert readers.list_media(spark, str(tmp_path / "nothing")).collect() == []


def test_stores_that_only_spark_reads(spark, tmp_path, monkeypatch):
    vectors = pa.table({"video_id": ["a", "b"], "segment_index": [1, 2], "segment_embedding": [[[1.0, 2.0]], None]})
    pq.write_table(vectors, tmp_path / "segment_a.parquet")
    pq.write_table(pa.table({"video_id": ["v"], "text_embedding": [[1.0, 2.0]]}), tmp_path / "video_a.parquet")
    (tmp_path / "none.parquet").write_bytes(b"")
    near = [sorted(map(str, df.collect())) for df in readers.route_parquet(spark, [str(tmp_path / "segment_a.parquet"), str(tmp_path / "video_a.parquet")])]
    monkeypatch.setattr(files, "store_of", lambda uri: None)
    monkeypatch.setattr(readers, "store_of", lambda uri: None)
    far = [sorted(map(str, df.collect())) for df in readers.route_parquet(spark, [str(tmp_path / "segment_a.parquet"), str(tmp_path / "video_a.parquet")])]
    assert near == far and [len(x) for x in far] == [1, 2]
    assert {(r["path"].rsplit("/", 1)[1], r["size"] > 0) for r in readers.list_media(spark, str(tmp_path)).collect()} == {("segment_a.parquet", True), ("video_a.parquet", True), ("none.parquet", False)}


def test_columns_of_any_type():
    nested = pa.array([[[1.0, 2.0], [9.0]], None, [], [None], [[3.0]]], pa.list_(pa.list_(pa.float64())))
    assert files.first_vectors(nested).to_pylist() == [[1.0, 2.0], None, [], [], [3.0]]
    assert files.first_vectors(nested[1:]).to_pylist() == [None, [], [], [3.0]]
    assert files.first_vectors(pa.array([[1, 2], None], pa.large_list(pa.int32()))).to_pylist() == [[1.0, 2.0], None]
    assert files.first_vectors(pa.nulls(2)).to_pylist() == [None, None] == files.first_vectors(pa.array([1, 2])).to_pylist()
    assert files.as_type(pa.array([" 2.5", None]), pa.float64()).to_pylist() == [2.5, None]
    assert files.as_type(pa.array(["a", "b"]).dictionary_encode(), pa.string()).to_pylist() == ["a", "b"]
    assert files.as_type(pa.array([7]), pa.string()).to_pylist() == ["7"]
    with pytest.raises(pa.ArrowInvalid):
        files.as_type(pa.array(["soon"]), pa.float64())


def test_metadata_of_any_shape():
    kind = pa.struct([("fps", pa.int64()), ("lang", pa.string()), ("more", pa.struct([("a", pa.list_(pa.float64())), ("b", pa.string())]))])
    rows = pa.array([{"fps": 30, "lang": "é", "more": {"a": [1.5, None], "b": None}}, {"fps": None, "lang": None, "more": None}, None], kind)
    assert files.json_texts(rows, 3).to_pylist() == ['{"fps":30,"lang":"é","more":{"a":[1.5,null]}}', "{}", "null"]
    maps = pa.array([[("k", 1)], []], pa.map_(pa.string(), pa.int64()))
    assert files.json_texts(maps, 2).to_pylist() == ['{"k":1}', "{}"]
    assert files.json_texts(pa.array(['{"a": 1}', None]), 2).to_pylist() == ['{"a": 1}', "null"]
    assert files.json_texts(None, 2).to_pylist() == ["null", "null"]


def test_files_of_many_types_make_one_scan(spark, tmp_path):
    for i, kind in enumerate((pa.int32(), pa.int64(), pa.float64(), pa.string())):
        for part in range(3):
            pq.write_table(pa.table({"video_id": [f"{i}-{part}"], "segment_index": pa.array([str(part)]).cast(kind)}), tmp_path / f"segment_{i}_{part}.parquet")
    got = readers.read_segments(spark, str(tmp_path))
    assert got.groupBy("segment_index").agg(F.count(F.lit(1)).alias("n")).orderBy("segment_index").collect() == [(i, 4) for i in range(3)]
    plan = got._jdf.queryExecution().toString()
    assert plan.count("MapInArrow") and "Union" not in plan.split("Physical")[0]
