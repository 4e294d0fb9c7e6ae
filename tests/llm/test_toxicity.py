import random
import zlib

import numpy as np

from mediatrends.llm.toxicity import BITS, START, fit, noisy_or, sentences, toxicity
from mediatrends.llm.toxicity import _features, _segments
from tests.conftest import SF

SCHEMA, LABELS = "doc_id long, text string", "doc_id long, toxic int"
INSULTS = ["grobian", "numbskull", "blockhead"]


def corpus(n, seed):
    draw = random.Random(seed)
    words = ["".join(draw.choice("aeiourstlnm") for _ in range(draw.randint(2, 7))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        said = [" ".join(draw.choice(words) for _ in range(draw.randint(3, 12))) + "." for _ in range(draw.randint(1, 12))]
        toxic = int(draw.random() < 0.25)
        if toxic:
            said[draw.randrange(len(said))] = f"you are a {draw.choice(INSULTS)}, {draw.choice(words)}!"
        rows.append((i, " ".join(said)))
        labels.append((i, toxic))
    return rows, labels


def test_noisy_or():
    logits = np.array([-1.0, 0.5, -3.0])
    p = 1 / (1 + np.exp(-logits))
    assert abs(noisy_or(logits) - (1 - np.prod(1 - p))) < 1e-12 and noisy_or(np.zeros(0)) == 0


def test_sentences():
    words, starts = sentences("One two. Three\n\nfour? five... six\n ! seven")
    assert [w.decode() for w in words] == ["One", "two.", "Three", "four?", "five...", "six", "!", "seven"]
    assert starts.tolist() == [0, 2, 3, 4, 5, 6, 7]


def test_weights_find_the_word_that_labels_share():
    rows, labels = corpus(400, 1)
    each = [sentences(t) for _, t in rows]
    features, starts = [], []
    for words, first in each:
        own = [_features(w.decode()) for w in words]
        upto = np.cumsum([0, *map(len, own)])
        features.append(np.array([f for o in own for f in o], np.int32))
        starts.append(upto[first])
    weights, bias = fit([y for _, y in labels], features, starts)
    scores = np.array([noisy_or(_segments(weights[f].astype(float), s) + bias) for f, s in zip(features, starts)])
    toxic = np.array([y for _, y in labels]) > 0
    assert ((scores >= 0.3) == toxic).mean() > 0.97


def test_held_out_documents_and_places(spark):
    rows, labels = corpus(1200, 2)
    docs, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)
    got = {r.doc_id: r for r in toxicity(docs, known).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [(got[i].predicted, y) for i, y in labels if got[i].held_out]
    assert np.mean([p == y for p, y in held]) > 0.95
    located = [(t, got[i].offending) for i, t in rows if labels[i][1] and got[i].predicted]
    right = sum(any(w in t[int(a) : int(b)] for a, b in (s.split(":") for s in o.split(",") if s) for w in INSULTS) for t, o in located)
    assert right > 0.9 * len(located)
    # labels of held-out documents are not learned from
    flipped = [(i, 1 - y if got[i].held_out else y) for i, y in labels]
    again = {r.doc_id: r.score for r in toxicity(docs, spark.createDataFrame(flipped, LABELS)).collect()}
    assert all(abs(again[i] - r.score) < 1e-6 for i, r in got.items())


def test_given_documents(spark):
    sf = SF.replace("0.001", "0.1")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity(spark.read.parquet(f"{sf}/documents.parquet"), labels).filter("held_out").join(labels, "doc_id").collect()
    toxic = [r.predicted for r in got if r.toxic]
    assert np.mean([r.predicted == r.toxic for r in got]) > 0.94 and sum(toxic) > 0.6 * len(toxic)


def test_odd_tables(spark):
    df = spark.createDataFrame([(None, None, 0.5), (1, "", 0.5), (2, "you numbskull " * 50_000, 0.5), (2, "twice", 0.5)], SCHEMA + ", score double")
    labels = spark.createDataFrame([(None, 1), (1, None), (2, 5), (2, 1), (2, 0)], LABELS)
    got = sorted((r.doc_id or 0, r.score, r.predicted) for r in toxicity(df, labels).collect())
    assert len(got) == 4 and got[0][1:] == got[1][1:] == (0.0, 0)
    assert len(toxicity(df, labels.limit(0)).filter("predicted = 0").collect()) == 4
    assert toxicity(df.limit(0), labels).collect() == []
    weights, bias = fit([], [], [])
    assert len(weights) == 1 << BITS and bias == START and not weights.any()
