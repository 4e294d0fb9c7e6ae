from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from mediatrends.functions.providers import trigram_embedder
from mediatrends.operators.history import query_activity, windowed_query_volume
from mediatrends.operators.popularity import video_stats
from mediatrends import schemas
from mediatrends.plans import jobs
from mediatrends.plans.jobs import trend_job
from mediatrends.sources import writers
from mediatrends.sources.buckets import BucketTable
from mediatrends.streaming import jobs as S

T0 = datetime(2024, 1, 1)


def drop(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def once(spark, schema, path):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_stats_over_batches_equal_batch_job(spark, tmp_path):
    schema = "kind string, Id long, VideoId long, VideoShareId long, ts timestamp"
    first = [("like", 1, 0, None, T0), ("like", 2, 0, None, T0), ("view", 1, 1, None, T0), ("post", 1, None, 7, T0)]
    second = [("share", 7, 1, None, T0), ("like", 2, 0, None, T0), ("post", 2, None, 7, T0), ("share", 8, 2, None, T0)]
    source, state, check = (str(tmp_path / n) for n in ("in", "state", "check"))
    for rows in (first, second):
        drop(spark, rows, schema, source)
        S.stream_stats(once(spark, schema, source), state, check).awaitTermination()
    videos = spark.createDataFrame([(0,), (1,), (2,), (3,)], "id long")
    reports = spark.createDataFrame([(2, False)], "VideoId long, IsResolved boolean")
    rows = spark.createDataFrame(first + second, schema).dropDuplicates(["kind", "Id"])
    kind = lambda k, *c: rows.filter(F.col("kind") == k).select(*c)
    want = video_stats(videos, kind("like", "Id", "VideoId"), kind("view", "Id", "VideoId"), kind("share", "Id", "VideoId"), kind("post", "Id", "VideoShareId"), reports)
    got = S.streamed_stats(videos, reports, state)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) == [(0, 2, 0, 0, 0), (1, 0, 1, 1, 2), (3, 0, 0, 0, 0)]


def test_trends_over_batches(spark, tmp_path):
    schema = "id string, chat_id string, query string, created_at timestamp"
    source, stored, out, check = (str(tmp_path / n) for n in ("in", "history", "trends", "check"))
    for b in range(2):
        drop(spark, [(f"{b}-{i}", "c", "red shoes" if i % 2 else "Blue hat!", T0 + timedelta(minutes=b)) for i in range(8)], schema, source)
        S.stream_trends(once(spark, schema, source), stored, out, check, trigram_embedder(256)).awaitTermination()
    trends = spark.read.parquet(out)
    counts = {(r["batch_timestamp"], r["representative_query"]): r["query_count"] for r in trends.collect()}
    assert counts == {(T0 + timedelta(minutes=b), q): 4 * (b + 1) for b in range(2) for q in ("red shoes", "blue hat")}
    assert spark.read.parquet(stored).count() == 16


def test_late_and_repeated_interactions_count_once(spark, tmp_path):
    schema = "kind string, Id long, VideoId long, VideoShareId long, ts timestamp"
    source, state, check = (str(tmp_path / n) for n in ("in", "state", "check"))
    late = T0 - timedelta(days=400)
    for rows in ([("view", 1, 0, None, T0)], [("view", 2, 0, None, late), ("view", 1, 0, None, T0), ("share", 5, 0, None, T0)], [("share", 5, 0, None, late), ("post", 9, None, 5, late)]):
        drop(spark, rows, schema, source)
        S.stream_stats(once(spark, schema, source), state, check).awaitTermination()
    videos = spark.createDataFrame([(0,)], "id long")
    got = S.streamed_stats(videos, spark.createDataFrame([], "VideoId long, IsResolved boolean"), state).first()
    assert tuple(got) == (0, 0, 2, 1, 1)


def test_streams_start_on_stored_tables(spark, tmp_path):
    schema = "id string, chat_id string, query string, created_at timestamp"
    source, stored, out, check = (str(tmp_path / n) for n in ("in", "history", "trends", "check"))
    drop(spark, [(f"old-{i}", "c", "red shoes", T0) for i in range(5)], schema, stored)
    drop(spark, [(f"new-{i}", "c", "red shoes", T0 + timedelta(minutes=1)) for i in range(3)], schema, source)
    S.stream_trends(once(spark, schema, source), stored, out, check, trigram_embedder(64)).awaitTermination()
    assert writers.existing(spark, stored, S.HISTORY_INPUT).count() == 8
    assert [r["query_count"] for r in spark.read.parquet(out).collect()] == [8]


def test_ingest(spark, tmp_path):
    frame = pd.DataFrame([{"video_id": "a", "tenant_id": "t", "segment_index": 1, "segment_start_time": 0.0, "segment_end_time": 1.0, "segment_text": "x", "segment_embedding": [[1.0, 2.0]]}])
    source = tmp_path / "in"
    source.mkdir()
    schema = "video_id string, tenant_id string, segment_index long, segment_start_time double, segment_end_time double, segment_text string, segment_embedding array<array<double>>"
    for name in ("segment_a.parquet", "segment_b.parquet"):
        frame.to_parquet(source / name)
        S.stream_ingest(once(spark, schema, str(source)), "segments", str(tmp_path / "table"), str(tmp_path / "check")).awaitTermination()
    table = spark.read.parquet(str(tmp_path / "table"))
    assert table.count() == 2 and table.first()["segment_embedding"] == [1.0, 2.0]


def test_ingest_rejects_known_video(spark, tmp_path):
    schema = "video_id string, tenant_id string, title string, video_url string, video_metadata string, video_text string, text_embedding array<double>"
    source, table, check = (str(tmp_path / n) for n in ("in", "table", "check"))
    row = ("a", "t", None, None, "null", "x", [1.0])
    drop(spark, [row], schema, source)
    S.stream_ingest(once(spark, schema, source), "videos", table, check).awaitTermination()
    assert spark.read.parquet(table).count() == 1
    drop(spark, [row], schema, source)
    with pytest.raises(Exception, match="duplicate video id"):
        S.stream_ingest(once(spark, schema, source), "videos", table, check).awaitTermination()
    assert spark.read.parquet(table).count() == 1


def test_windows_drop_late_rows(spark, tmp_path):
    schema = "id long, query string, created_at timestamp"
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    first = [(1, "A", T0), (2, "a", T0 + timedelta(minutes=1)), (3, "b", T0 + timedelta(minutes=40))]
    late = [(4, "a", T0 + timedelta(minutes=2)), (5, "b", T0 + timedelta(minutes=41)), (6, "c", T0 + timedelta(minutes=90))]
    for rows in (first, late):
        drop(spark, rows, schema, source)
        S.stream_query_volume(once(spark, schema, source), out, check).awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(out).select("start", "query", "query_count", "recency").collect())
    kept = spark.createDataFrame(first + late[1:2], schema)
    want = sorted(tuple(r) for r in windowed_query_volume(kept).select("start", "query", "query_count", "recency").collect())
    assert got == want and len(got) == 2


def test_scratch_tables_are_deleted(spark, tmp_path):
    import os

    from mediatrends.operators.dbscan import dbscan
    from mediatrends.session import scratch_root

    folder = f"{scratch_root(spark)}/mediatrends"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    points = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(30)], "id long, embedding array<double>")
    labels = dbscan(points, 0.001)
    assert labels.count() == 30
    assert set(os.listdir(folder)) - before == {labels.scratch_path.rsplit("/", 1)[1]}
    assert writers.existing(spark, str(tmp_path / "none"), labels.schema).isEmpty()


# --- state in buckets ---------------------------------------------------------------------


def opened(df):
    return {path.split("/data/", 1)[1].rsplit("/", 1)[0] for path in df.inputFiles()}


def test_bucket_table_reads_and_writes_its_own_buckets_only(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path / "t"), S.SEEN, ["kind", "Id"], buckets=8)
    rows = lambda ids: spark.createDataFrame([("like", i) for i in ids], S.SEEN)
    table.append(rows(range(100)), 0)
    before = table.versions()
    assert sorted(before) == list(range(8))
    one = rows([1000])
    (touched,) = table.touched(one)
    plan = table.unknown(one, 1)
    assert {p for p in opened(plan) if "bucket=" in p} == {f"batch_id=0/bucket={touched}"}
    table.append(one, 1)
    after = table.versions()
    assert after.pop(touched) == [0, 1] and before.pop(touched) == [0] and after == before
    assert table.read().count() == 101 and table.read(1).count() == 100
    assert table.unknown(rows([5, 1000, 2000]), 2).collect() == [("like", 2000)]


def test_bucket_table_compacts_replays_and_cleans_up(spark, tmp_path):
    import os

    path = str(tmp_path / "t")
    table = BucketTable(spark, path, S.SEEN, ["kind", "Id"], buckets=2)
    rows = lambda ids: spark.createDataFrame([("like", i) for i in ids], S.SEEN)
    for batch in range(6):
        table.append(rows(range(10 * batch, 10 * batch + 10)), batch, deltas=3)
        table.append(rows(range(10 * batch, 10 * batch + 10)), batch, deltas=3)  # a replay changes nothing
        assert sorted(r.Id for r in table.read().collect()) == list(range(10 * batch + 10))
        assert all(len(v) <= 3 for v in table.versions().values())
    assert sorted(os.listdir(f"{path}/manifest")) == ["batch_id=4", "batch_id=5"]
    named = {v for b in (5, 6) for vs in table.versions(b).values() for v in vs}
    left = {int(d.split("=")[1]) for d in os.listdir(f"{path}/data") if any(n.startswith("bucket") for n in os.listdir(f"{path}/data/{d}"))}
    assert left == named
    with pytest.raises(ValueError, match="buckets"):
        BucketTable(spark, path, S.SEEN, ["kind", "Id"], buckets=4).read()
    empty = BucketTable(spark, str(tmp_path / "none"), S.SEEN, ["kind", "Id"])
    assert empty.is_empty() and empty.read().count() == 0


def test_batches_merge_like_one_history(spark):
    schema = "id string, query string, created_at timestamp"
    parts = [
        [("1", "a", T0), ("2", "a", T0 + timedelta(minutes=3)), ("3", "b", None)],
        [("4", "a", T0 - timedelta(days=400)), ("5", "b", T0 + timedelta(minutes=1)), ("6", "c", None), ("7", "a", T0 + timedelta(minutes=9))],
    ]
    states = [S.text_state(spark.createDataFrame(p, schema)) for p in parts]
    both = spark.createDataFrame(parts[0] + parts[1], schema)
    for as_of in (T0 + timedelta(minutes=10), T0 - timedelta(minutes=200)):
        want = {r.query: (r.n, r.recency, r.first_row) for r in query_activity(both, as_of).collect()}
        got = {r.query: (r.n, r.recency, r.first_row) for r in S.state_activity(S.merged_state(*states), as_of).collect()}
        assert got.keys() == want.keys()
        for q in want:
            assert got[q][0] == want[q][0] and got[q][2] == want[q][2] and got[q][1] == pytest.approx(want[q][1], rel=1e-9)


def test_the_model_is_asked_for_new_texts_only(spark, tmp_path):
    schema = "id string, chat_id string, query string, created_at timestamp"
    source, stored, out, check, asked = (str(tmp_path / n) for n in ("in", "history", "trends", "check", "asked"))
    embed = trigram_embedder(128)

    def recording(texts):
        with open(asked, "a") as log:
            log.writelines(t + "\n" for t in texts)
        return [None if t == "no vector" else v for t, v in zip(texts, embed(texts))]

    seen = []
    for b, words in enumerate((["red shoes", "Blue hat", "no vector", ""], ["red shoes", "green coat", "no vector"], ["blue hat"])):
        rows = [(f"{b}-{i}", "c", words[i % len(words)], T0 + timedelta(minutes=b, seconds=i)) for i in range(12)]
        drop(spark, rows, schema, source)
        S.stream_trends(once(spark, schema, source), stored, out, check, recording, buckets=4).awaitTermination()
        texts = open(asked).read().split("\n")[:-1]
        seen.append(sorted(texts))
        # the trends are those of the batch job over all rows so far
        history = writers.existing(spark, stored, S.HISTORY_INPUT)
        moment = T0 + timedelta(minutes=b, seconds=11)
        want = trend_job(history, moment, lambda t: [None if x == "no vector" else v for x, v in zip(t, embed(t))]).trends
        got = spark.read.parquet(out).filter(F.col("batch_timestamp") == moment)
        names = ["representative_query", "trend_score", "query_count", "unique_query_count", "top_queries"]
        assert sorted(map(str, got.select(*names).collect())) == sorted(map(str, want.select(*names).collect())) != []
    assert seen == [["blue hat", "no vector", "red shoes"], ["blue hat", "green coat", "no vector", "red shoes"], ["blue hat", "green coat", "no vector", "red shoes"]]


def test_every_batch_publishes_statistics(spark, tmp_path):
    schema = "kind string, Id long, VideoId long, VideoShareId long"
    source, state, check, out = (str(tmp_path / n) for n in ("in", "state", "check", "stats"))
    videos = spark.createDataFrame([(0,), (1,)], "id long")
    reports = spark.createDataFrame([], "VideoId long, IsResolved boolean")
    batches = [
        [("post", 1, None, 5), ("post", 2, None, 5), ("like", 1, 0, None), (None, 9, 0, None), ("like", None, 0, None)],
        [("share", 5, 1, None), ("post", 2, None, 5), ("post", 3, None, 5)],
        [("share", 5, 1, None), ("post", 4, None, 5), ("view", 1, None, None), ("like", 1, 1, None)],
    ]
    want = [{0: (1, 0, 0, 0), 1: (0, 0, 0, 0)}, {0: (1, 0, 0, 0), 1: (0, 0, 1, 3)}, {0: (1, 0, 0, 0), 1: (0, 0, 1, 4)}]
    for rows, expected in zip(batches, want):
        drop(spark, rows, schema, source)
        S.stream_stats(once(spark, schema, source), state, check, videos=videos, reports=reports, stats_path=out, buckets=4).awaitTermination()
        assert {r[0]: tuple(r)[1:] for r in writers.read_stats(spark, out).collect()} == expected


# --- mixed files ----------------------------------------------------------------------------


def segment_file(path, video, vectors, **extra):
    n = len(vectors)
    frame = {"video_id": video, "tenant_id": "t", "segment_index": range(1, n + 1), "segment_start_time": [float(i) for i in range(n)], "segment_end_time": 1.5, "segment_text": "x", "segment_embedding": vectors}
    pd.DataFrame(frame | extra).to_parquet(path)


def video_file(path, video, metadata=None, vector=(1.0, 2.0)):
    pd.DataFrame([{"video_id": video, "tenant_id": "t", "title": None, "video_url": "u", "video_metadata": metadata, "video_text": "text", "text_embedding": vector}]).to_parquet(path)


def flat(table):
    return sorted(str({k: v for k, v in r.asDict().items() if k != "id" or "title" in r}) for r in table.collect())


def test_one_stream_of_mixed_files_equals_the_batch_job(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    parts = [
        lambda: (segment_file(source / "segment_a.parquet", "a", [[[1.0, 2.0]], [[3.0, 4.0]]]), video_file(source / "video_a.parquet", "a", {"fps": 30})),
        lambda: (segment_file(source / "segment_b.parquet", "b", [[5.0, 6.0]], segment_start_time="2.5"), video_file(source / "other.parquet", "b", "text"), pd.DataFrame().to_parquet(source / "segment_none.parquet")),
        lambda: (segment_file(source / "segment_a again.parquet", "a", [[1.0, 2.0], [3.0, 4.0], [5.0, 5.0]]), video_file(source / "video_c.parquet", "c", {"tags": ["x"]}, None)),
    ]
    paths = {n: str(tmp_path / n) for n in ("videos", "segments", "bad", "check")}
    for write in parts:
        write()
        S.stream_mixed_ingest(S.file_stream(spark, str(source), 2), paths["videos"], paths["segments"], paths["bad"], paths["check"], dim=2, dedupe=True, buckets=4).awaitTermination()
    jobs.ingest_parquet(spark, str(source), str(tmp_path / "v"), str(tmp_path / "s"), dim=2, dedupe=True)
    for name, own in (("videos", "v"), ("segments", "s")):
        kind = schemas.relaxed(schemas.VIDEOS if name == "videos" else schemas.SEGMENTS)
        got, want = writers.existing(spark, paths[name], kind), writers.existing(spark, str(tmp_path / own), kind)
        assert flat(got) == flat(want) and got.count() == {"videos": 3, "segments": 4}[name]
    assert spark.read.option("recursiveFileLookup", "true").parquet(paths["bad"]).isEmpty()


def test_bad_files_are_set_aside_and_do_not_stop_the_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    paths = {n: str(tmp_path / n) for n in ("videos", "segments", "bad", "check")}
    old = [("old", "t", "x", "u", "null", "t", [1.0, 2.0])]
    spark.createDataFrame(old, schemas.relaxed(schemas.VIDEOS)).write.parquet(paths["videos"])
    video_file(source / "video_1.parquet", "a")
    video_file(source / "video_2.parquet", "a")
    video_file(source / "video_3.parquet", "old")
    video_file(source / "video_4.parquet", None)
    video_file(source / "video_5.parquet", "wide", None, [1.0, 2.0, 3.0])
    segment_file(source / "segment_1.parquet", "a", [[1.0, 2.0], [1.0]])
    segment_file(source / "segment_2.parquet", "a", [[1.0, 2.0]], segment_start_time="soon")
    segment_file(source / "segment_3.parquet", "a", [[1.0, 2.0]])
    (source / "segment_4.parquet").write_bytes(b"no parquet")
    for _ in range(2):
        S.stream_mixed_ingest(S.file_stream(spark, str(source)), paths["videos"], paths["segments"], paths["bad"], paths["check"], dim=2, buckets=2).awaitTermination()
    videos = writers.existing(spark, paths["videos"], schemas.relaxed(schemas.VIDEOS))
    assert sorted(r["id"] for r in videos.collect()) == ["a", "old"]
    assert writers.existing(spark, paths["segments"], schemas.relaxed(schemas.SEGMENTS)).count() == 1
    bad = spark.read.option("recursiveFileLookup", "true").parquet(paths["bad"]).collect()
    told = {r["path"].rsplit("/", 1)[1]: r["error"] for r in bad}
    assert set(told) == {"video_2.parquet", "video_3.parquet", "video_4.parquet", "video_5.parquet", "segment_1.parquet", "segment_2.parquet", "segment_4.parquet"}
    assert told["video_2.parquet"] == told["video_3.parquet"] == "duplicate video id"
    assert told["video_4.parquet"] == "video_id is required" and "expected 2 dimensions, not 1" == told["segment_1.parquet"]
    # a later file of a known video is refused, too
    video_file(source / "video_6.parquet", "a")
    S.stream_mixed_ingest(S.file_stream(spark, str(source)), paths["videos"], paths["segments"], paths["bad"], paths["check"], dim=2, buckets=2).awaitTermination()
    assert writers.existing(spark, paths["videos"], schemas.relaxed(schemas.VIDEOS)).count() == 2
