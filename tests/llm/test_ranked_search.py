import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from mediatrends.llm import ranked_search as rs
from mediatrends.llm.ranked_search import build_index, ranked_search, terms

SCHEMA, ITEMS = "doc_id long, text string", "item_id long, text string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, top=20):
    """Scores of all documents for all items, by the contract."""
    counts = [Counter(words(t)) for _, t in docs]
    sizes = [sum(c.values()) for c in counts]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in sorted(set(items), key=str):
        scores = []
        for (doc, _), c, size in zip(docs, counts, sizes):
            m = 75 + 25 * size * n // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m)) for t in words(text) if c[t])
            if score > 0:
                scores.append((-score, doc is None, doc))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


def found(spark, docs, items):
    got = ranked_search(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, ITEMS))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, got.collect()), key=str)


def corpus(n, seed=1, vocabulary=300):
    draw = random.Random(seed)
    return [(i, " ".join(f"w{int(vocabulary * draw.random() ** 3)}" for _ in range(draw.randrange(1, 200)))) for i in range(n)]


def test_terms():
    text = "Ab-c1_É \x7fx\x00y İß 10%ʼ z"
    assert [t.decode() for t in terms(text)] == words(text)


@pytest.mark.parametrize("bits,entries", [(10, 1 << 19), (1, 2000)])
def test_equals_scores_of_all_documents(spark, monkeypatch, bits, entries):
    # narrow signatures are full of wrong bits; the result stays the same
    monkeypatch.setattr(rs, "BITS", bits)
    monkeypatch.setattr(rs, "ENTRIES", entries)
    docs = corpus(400)
    docs += [(1000 + i, docs[5][1]) for i in range(150)]  # many equal texts, equal scores
    items = [(i, docs[7 * i][1][:120].upper()) for i in range(15)] + [(20, "w1 w1 w2"), (21, "w299 unknown"), (22, "unknown")]
    assert found(spark, docs, items) == plain(docs, items)


def test_bounds_never_fall_below_scores():
    docs = corpus(300, seed=4)
    counts = [Counter(terms(t)) for _, t in docs]
    sizes = np.array([sum(c.values()) for c in counts])
    df = Counter(t for c in counts for t in c)
    items = [[(t, c) for t, c in list(counts[i].items())[:30]] for i in range(0, 300, 10)]
    queries = rs.Queries(items, df, len(docs), int(sizes.sum()))
    width, held = rs.slices_of([rs.entries(c) for c in counts])
    for item, bound in enumerate(queries.bounds(width, held, sizes, np.array([max(c.values()) for c in counts]))):
        exact = np.array([queries.score(item, c, int(s)) for c, s in zip(counts, sizes)])
        assert (bound >= exact).all()
        assert (bound > 1.2 * exact + 1e6).mean() < 0.2  # and they are close


def test_nulls_repeats_ties_and_odd_texts(spark):
    docs = [(None, "red apple"), (None, "red apple"), (3, "red apple"), (3, "red apple"), (3, "green pear"), (4, None), (5, ""), (6, " .,! "), (7, "Red"), (8, "x" * 300_000 + " red")]
    items = [(1, "red"), (1, "red"), (1, "PEAR"), (None, "apple apple"), (2, None), (3, ""), (4, "...")]
    assert found(spark, docs, items) == plain(docs, items)


def test_long_texts_and_several_passes(spark, monkeypatch):
    monkeypatch.setattr(rs, "ITEMS", 2)
    monkeypatch.setattr(rs, "LEXICON_TERMS", 50)
    monkeypatch.setattr(rs, "MOST_BITS", 4096)
    draw = random.Random(8)
    docs = corpus(40) + [(100, " ".join(f"u{draw.randrange(10**6)}" for _ in range(60_000)) + " w1 w2 w3")]
    items = [(i, f"w{i} w{2 * i + 1} w3") for i in range(5)]
    assert found(spark, docs, items) == plain(docs, items)


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "red", 1, "a"), (2, "blue", 2, "b")], SCHEMA + ", rank int, item_id string")
    items = spark.createDataFrame([(1, "red", "y")], ITEMS + ", doc_id string")
    assert [tuple(r) for r in ranked_search(docs, items).collect()] == [(1, 1, 1, r.score) for r in ranked_search(docs, items).collect()]
    for given in ((docs.limit(0), items), (docs, items.limit(0)), (docs.limit(0), items.limit(0))):
        got = ranked_search(*given)
        assert got.collect() == [] and got.columns == ["item_id", "rank", "doc_id", "score"]


def test_the_index_is_built_without_a_shuffle(spark):
    docs = spark.createDataFrame(corpus(100), SCHEMA)
    index = build_index(docs)
    total = index.filter("slices IS NOT NULL").selectExpr("sum(size(ids))", "sum(n_terms)").first()
    assert tuple(total) == (100, sum(len(words(t)) for _, t in corpus(100)))
    held = dict(index.selectExpr("explode(arrays_zip(terms, holding)) t").selectExpr("string(t.terms) term", "t.holding n").groupBy("term").sum("n").collect())
    assert held == Counter(t for _, text in corpus(100) for t in set(words(text)))
