import random

from mediatrends.llm.mixing import mix_documents, mix_sources
from tests.llm import plain

SCHEMA = "doc_id long, text string, source string"


def rows_of(seed, n=80):
    draw = random.Random(seed)
    sources = ["a", "ä", "b", "Z", None, "tiny"]
    rows = [(i, "w " * draw.randint(0, 40), draw.choice(sources[:5])) for i in range(n)]
    return rows + [(n, "one two", "tiny"), (n + 1, None, "a")]


def test_equals_plain_version(spark):
    for seed in (1, 2):
        rows = rows_of(seed)
        want = plain.mix(rows)
        got = mix_sources(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
        assert {r.doc_id: r.copies for r in got} == {i: c for i, (c, _) in want.items()}
        assert all(abs(r.target - want[r.doc_id][1]) < 1e-9 and r.taken == r.copies * r.size for r in got)


def test_near_the_targets_and_within_three_times(spark):
    rows = rows_of(3, 400)
    got = mix_sources(spark.createDataFrame(rows, SCHEMA)).collect()
    for source in {r.source for r in got}:
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 2 * max(r.size for r in own)
    assert all(r.taken <= 3 * r.size for r in got)
    assert sum(r.taken for r in got) <= sum(r.size for r in got)


def test_reruns_agree(spark):
    df = spark.createDataFrame(rows_of(4), SCHEMA)
    first, second = (sorted((r.doc_id, r.taken) for r in mix_sources(d).collect()) for d in (df, df.repartition(7)))
    assert first == second


def test_odd_tables(spark):
    assert mix_sources(spark.createDataFrame([], SCHEMA)).collect() == []
    blank = mix_sources(spark.createDataFrame([(None, None, None), (1, "", "a")], SCHEMA)).collect()
    assert [(r.size, r.taken) for r in blank] == [(0, 0), (0, 0)]
    clash = spark.createDataFrame([(1, "a b", "s", 5, "x"), (1, "a b", "s", 5, "x")], SCHEMA + ", size int, key string")
    assert [(r.size, r.taken) for r in mix_sources(clash).collect()] == [(2, 2), (2, 2)]
    taken = mix_documents(clash).collect()
    assert [(r.size, r["key"], r.mix_copies, r.mix_taken) for r in taken] == [(5, "x", 2, 4)]
