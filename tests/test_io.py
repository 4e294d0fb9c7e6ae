import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from mediatrends.functions.providers import trigram_embedder
from mediatrends.plans import jobs
from mediatrends.sources import readers, writers


def segment_frame(video, vectors, **extra):
    return pd.DataFrame(
        {
            "video_id": video, "tenant_id": "t", "segment_index": range(1, len(vectors) + 1),
            "segment_start_time": [float(i) for i in range(len(vectors))], "segment_end_time": 1.5,
            "segment_text": "x", "segment_embedding": vectors, **extra,
        }
    )


def video_frame(video, metadata, embedding=([1.0, 2.0],)):
    return pd.DataFrame([{"video_id": video, "tenant_id": "t", "title": None, "video_url": "u", "video_metadata": metadata, "video_text": "text", "text_embedding": list(embedding)}])


@pytest.fixture
def files(tmp_path):
    segment_frame("a", [[[1.0, 2.0]], [[3.0, 4.0]]]).to_parquet(tmp_path / "segment_a.parquet")
    segment_frame("b", [[5.0, 6.0]]).to_parquet(tmp_path / "segment_b.parquet")
    segment_frame("c", [[7.0, 8.0]], segment_start_time="2.5").to_parquet(tmp_path / "segment_c.parquet")
    pd.DataFrame().to_parquet(tmp_path / "segment_d.parquet")
    video_frame("a", {"fps": 30, "lang": "é"}).to_parquet(tmp_path / "video_a.parquet")
    video_frame("b", {"tags": ["x"]}, [[3.0, 4.0]]).to_parquet(tmp_path / "video_b.parquet")
    video_frame("c", None, [9.0, 9.0]).to_parquet(tmp_path / "other.parquet")
    return str(tmp_path)


def test_drifting_files(spark, files):
    videos, segments = readers.route_parquet(spark, files, dim=2)
    got = {(r["video_id"], r["segment_index"]): r for r in segments.collect()}
    assert set(got) == {("a", 1), ("a", 2), ("b", 1), ("c", 1)}
    assert got["a", 2]["segment_embedding"] == [3.0, 4.0] and got["c", 1]["segment_start_time"] == 2.5
    got = {r["id"]: r for r in videos.collect()}
    assert set(got) == {"a", "b", "c"}
    assert json.loads(got["a"]["video_metadata"]) == {"fps": 30, "lang": "é"}
    assert json.loads(got["b"]["video_metadata"]) == {"tags": ["x"]} and got["c"]["video_metadata"] == "null"
    assert got["c"]["text_embedding"] == [9.0, 9.0]
    with pytest.raises(Exception, match="expected 3 dimensions"):
        readers.read_segments(spark, files + "/segment_b.parquet", dim=3).collect()


def test_only_files_without_columns(spark, files):
    assert readers.read_segments(spark, files + "/segment_d.parquet").count() == 0


def test_ingest(spark, files, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("tables"))
    jobs.ingest_parquet(spark, files, f"{out}/videos", f"{out}/segments", dim=2)
    stored = readers.read_table(spark, "video_segments", f"{out}/segments")
    assert stored.count() == 4 and stored.select("id").distinct().count() == 4
    with pytest.raises(writers.DuplicateVideoError):
        jobs.ingest_parquet(spark, files, f"{out}/videos", f"{out}/segments")
    assert readers.read_table(spark, "videos", f"{out}/videos").count() == 3
    assert readers.read_table(spark, "video_segments", f"{out}/segments").count() == 4
    _, again = readers.route_parquet(spark, files)
    writers.append_segments(again, f"{out}/segments", dedupe=True)
    assert readers.read_table(spark, "video_segments", f"{out}/segments").count() == 4
    writers.append_segments(again, f"{out}/segments")
    assert readers.read_table(spark, "video_segments", f"{out}/segments").count() == 8


def test_duplicate_inside_batch_writes_nothing(spark, tmp_path):
    batch = spark.createDataFrame([("a",), ("a",)], "id string")
    for c, kind in (("tenant_id", "string"), ("title", "string"), ("video_url", "string"), ("video_metadata", "string"), ("video_text", "string"), ("text_embedding", "array<float>")):
        batch = batch.withColumn(c, F.lit(None).cast(kind))
    with pytest.raises(writers.DuplicateVideoError):
        writers.append_videos(batch, str(tmp_path / "v"))
    assert not (tmp_path / "v").exists()


def test_path_checks(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a")
    with pytest.raises(ValueError):
        readers.check_parquet_paths(spark, str(tmp_path / "x.csv"))
    with pytest.raises(ValueError):
        readers.check_parquet_paths(spark, str(tmp_path / "x.PARQUET"))
    with pytest.raises(FileNotFoundError):
        readers.check_parquet_paths(spark, str(tmp_path / "none.parquet"))
    with pytest.raises(ValueError):
        readers.read_table(spark, "unknown", str(tmp_path))


def test_transcripts_to_tables(spark, tmp_path):
    media_dir = tmp_path / "media"
    media_dir.mkdir()
    for name, content in (("b.mp4", "x"), ("a.MOV", "x"), ("song.mp3", "x"), ("silent film.mp4", "x"), ("none.mp4", "")):
        (media_dir / name).write_text(content)
    lines = [
        {"video_id": "a", "segments": [{"start": 0.0, "end": 1.0, "text": " hello "}, {"start": 1.0, "end": 2.0, "text": " "}, {"start": 2.0, "end": 3.5, "text": "you\n"}]},
        {"video_id": "b", "segments": []},
    ]
    (tmp_path / "t.json").write_text("\n".join(json.dumps(x) for x in lines))
    empty = spark.createDataFrame([("/media/empty.mp4", 0)], "path string, size long")
    asked = spark.sparkContext.accumulator(0)
    plain = trigram_embedder(8)

    def counting(texts):
        asked.add(len(texts))
        return plain(texts)

    built = jobs.build_transcript_tables(
        readers.list_media(spark, str(media_dir)).union(empty), readers.read_transcripts(spark, str(tmp_path / "t.json")),
        counting, "tenant", metadata={"k": 1}, out_path=str(tmp_path / "out"),
    )
    videos = {r["id"]: r for r in built.videos.collect()}
    assert (videos["a"]["title"], videos["b"]["title"]) == ("video_1", "video_2")
    assert videos["a"]["video_text"] == "hello  you" and videos["b"]["text_embedding"] is None
    assert videos["a"]["video_metadata"] == '{"k":1}'
    # the silent second segment has no embedding and shifts nothing
    assert sorted((r["segment_index"], r["segment_text"], len(r["segment_embedding"])) for r in built.segments.collect()) == [(1, "hello", 8), (3, "you", 8)]
    assert {r["error"].split(":")[0] for r in built.rejected.collect()} == {"Unsuitable file type [audio]", "Input file missing or empty"}
    assert sorted(r["path"].rsplit("/", 1)[1] for r in built.rejected.collect()) == ["empty.mp4", "none.mp4", "silent film.mp4", "song.mp3"]
    assert asked.value == 3  # "hello  you", "hello" and "you", whatever was read since
    read = readers.read_segments(spark, str(tmp_path / "out" / "segment"), 8)
    assert read.count() == 2 and readers.read_videos(spark, str(tmp_path / "out" / "video")).count() == 2


def test_transcript_text_from_rows(spark):
    rows = spark.createDataFrame([("v", 2, "b"), ("v", 10, "c"), ("v", 1, "a")], "video_id string, segment_index long, segment_text string")
    assert jobs.transcript_text(rows).first()["video_text"] == "a b c"


def test_cluster_json_forms(spark, tmp_path):
    (tmp_path / "map.json").write_text(json.dumps({"0": [0, 2], "-1": [1], "7": [9]}, indent=2))
    got = readers.read_cluster_json(spark, str(tmp_path / "map.json"), n_rows=5)
    assert {tuple(r) for r in got.collect()} == {(0, 0), (0, 2), (-1, 1)}
    members = spark.range(25).select(F.lit(3).cast("long").alias("cluster_id"), F.col("id").alias("row_id"))
    writers.export_clusters_json(members, str(tmp_path / "lines"), chunk_rows=10)
    assert spark.read.json(str(tmp_path / "lines")).count() == 3
    assert readers.read_cluster_json(spark, str(tmp_path / "lines")).count() == 25
    (tmp_path / "e.json").write_text(json.dumps({"queries": ["ü", "b"], "embeddings": [[1.0], [2.0]]}))
    got = readers.read_embeddings_json(spark, str(tmp_path / "e.json")).orderBy("row_id").collect()
    assert [tuple(r) for r in got] == [(0, "ü", [1.0]), (1, "b", [2.0])]


def test_search_job(spark, tmp_path):
    embed = trigram_embedder(256)
    rows = [(f"s{i}", f"v{i % 2}", float(i), i + 1.0, t, embed([t])[0]) for i, t in enumerate(["red shoes", "blue hat", "red shoe", "green tea"])]
    segments = spark.createDataFrame(rows, "id string, video_id string, segment_start_time double, segment_end_time double, segment_text string, segment_embedding array<double>")
    asks = [("red shoes", "c", None), ("red shoes", "d", "t"), ("", "c", None), (None, "c", None), ("hat", "", None), ("void", "c", None)]
    queries = spark.createDataFrame(asks, "query string, chat_id string, temporary_id string")
    model = lambda texts: [None if t == "void" else embed([t])[0] for t in texts]
    got = jobs.search_job(queries, segments, model, k=3, history_path=str(tmp_path / "history")).collect()
    by = {(r["query"], r["chat_id"]): r for r in got}
    assert len(got) == 6
    assert [by[k]["error"] for k in (("", "c"), (None, "c"), ("hat", ""), ("void", "c"))] == [jobs.EMPTY_QUERY, jobs.EMPTY_QUERY, jobs.EMPTY_CHAT, jobs.EMPTY_EMBEDDING]
    hit = by["red shoes", "c"]
    assert hit["status"] == "Success" and hit["results"] == by["red shoes", "d"]["results"]
    assert [v["video_id"] for v in hit["results"]] == ["v0", "v1"] and sum(len(v["segments"]) for v in hit["results"]) == 3
    assert hit["results"][0]["segments"][0].asDict() == {"segment_text": "red shoes", "segment_start_time": 0.0, "segment_end_time": 1.0, "distance": 0.0}
    logged = readers.read_table(spark, "search_history", str(tmp_path / "history"))
    assert logged.count() == 2 and logged.first()["response"][0]["video_id"] == "v0"


def test_history_failure_is_not_raised(spark, tmp_path):
    (tmp_path / "blocked").write_text("")
    df = spark.sql("SELECT 'q' AS query, 'c' AS chat_id, CAST(NULL AS STRING) AS temporary_id, TIMESTAMP'2024-01-01' AS created_at, array(named_struct('video_id', 'v', 'segments', array(named_struct('segment_text', 'x', 'segment_start_time', 0D, 'segment_end_time', 1D, 'distance', 0D)))) AS results")
    assert writers.append_history(df, str(tmp_path / "blocked" / "x")) is False


def test_tuning_report(spark, embeddings):
    points = embeddings.select(F.col("vec_id").alias("row_id"), "embedding")
    members = embeddings.filter("label < 3").select(F.col("label").cast("long").alias("cluster_id"), F.col("vec_id").alias("row_id"))
    report = jobs.tuning_report(points, members, [1.05, 1.15], [2, 5])
    assert report["diagnostics"].first()["num_clusters"] == 3
    assert report["grid"].count() == 4 and report["pivot_num_clusters"].count() == 2
    assert report["silhouette"].first()[0] is not None
    assert set(report) >= {"size_histogram", "largest_clusters", "davies_bouldin", "calinski_harabasz", "best_silhouette", "best_davies_bouldin"}


def test_large_file_without_columns(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    bare = pa.table({}).replace_schema_metadata({"pandas": "x" * 200_000})
    pq.write_table(bare, tmp_path / "segment_bare.parquet")
    frame = pd.DataFrame([{"video_id": "a", "segment_index": 1, "segment_embedding": [1.0, 2.0]}])
    frame.to_parquet(tmp_path / "segment_full.parquet")
    frame.assign(segment_embedding=None).to_parquet(tmp_path / "segment_null.parquet")
    frame.assign(segment_index="2").to_parquet(tmp_path / "segment_text.parquet")
    got = readers.read_segments(spark, str(tmp_path)).orderBy("segment_index").collect()
    assert [r["segment_index"] for r in got] == [1, 1, 2]


def test_history_export_is_read_back(spark, tmp_path):
    rows = [(f"{i}", "c", q, f"2024-01-01T00:{i:02}:00") for i, q in enumerate(["red shoes", "Red shoes!", "blue hat", "blue hat", "green tea"])]
    history = spark.createDataFrame(rows, "id string, chat_id string, query string, created_at string").withColumn("created_at", F.to_timestamp("created_at"))
    jobs.full_history_clusters(history, trigram_embedder(64), out_path=str(tmp_path))
    points = readers.read_embeddings_json(spark, str(tmp_path / "embeddings"))
    assert points.count() == 5 and {tuple(r) for r in points.select("row_id", "query").collect()} == {
        (0, "green tea"), (1, "blue hat"), (2, "blue hat"), (3, "red shoes"), (4, "red shoes")}
    members = readers.read_cluster_json(spark, str(tmp_path / "clusters"))
    assert jobs.tuning_report(points, members, [0.5], [2])["diagnostics"].first()["total_points"] == 5
    (tmp_path / "odd.json").write_text('{"other": 1}')
    with pytest.raises(ValueError):
        readers.read_embeddings_json(spark, str(tmp_path / "odd.json"))
