"""Toxicity by multiple-instance learning: sentences are the instances, document labels train them.

A sentence's probability is logistic in its words and their beginnings; a document is toxic if any of its
sentences is, so its probability is the noisy-or of theirs. Only the documents are labelled. The trained
sentence scores then locate the offending sentences.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediatrends.llm.common import job, materialize, text_rows, type_of

BITS = 18
PREFIXES = (4, 5)  # beginnings of words in code points, so that inflected forms share a feature
TRAIN_ROWS = 16_000  # labelled documents that the model is fitted on, at most
THRESHOLD = 0.3
ROUNDS = 120
RATE = 0.1
DECAY = 1e-4
MIN_DOCS = 5  # toxic documents that a feature must occur in
START = -4.0

_MARKS = ".,;:!?\"'()[]{}<>*#|«»„“”…"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _features(word: str) -> list[int]:
    core = word.strip(_MARKS).lower()
    if not core:
        return []
    names = [core, *(f"{core[:n]}\0" for n in PREFIXES if len(core) > n)]
    return [xxhash.xxh3_64_intdigest(n.encode()) >> (64 - BITS) for n in names]


class _Words(dict):
    """Row of each written word in ``weights``, the sum over its features; forgotten when it grows too large."""

    MOST = 500_000

    def __init__(self, model: np.ndarray) -> None:
        super().__init__()
        self.model = model
        self.weights = np.zeros(self.MOST + 1, np.float64)

    def __missing__(self, raw: bytes) -> int:
        row = len(self)
        if row == len(self.weights):
            self.weights = np.concatenate([self.weights, np.zeros(row)])
        self.weights[row] = self.model[_features(raw.decode())].sum()
        self[raw] = row
        return row


def sentences(text: str) -> tuple[list[bytes], np.ndarray]:
    """The words of the text, and the place of the first word of each sentence.

    A sentence ends with a line, or after a word that ends in a full stop, an exclamation or a question mark.
    """
    words: list[bytes] = []
    starts = []
    for line in text.encode().split(b"\n"):
        found = line.split()
        if found:
            starts.append(len(words))
            at = len(words)
            starts += [at + i + 1 for i, w in enumerate(found[:-1]) if w[-1] in b".!?"]
            words += found
    return words, np.array(starts, dtype=np.int64)


def noisy_or(logits: np.ndarray) -> float:
    """The probability that any of the sentences is toxic."""
    return float(-np.expm1(-np.logaddexp(0, logits).sum())) if len(logits) else 0.0


def _examples(rows: DataFrame) -> DataFrame:
    """``label`` and, as binary, the features of all words and the place of each sentence's first feature."""

    def run(batches):
        for batch in batches:
            features, starts = [], []
            for text in batch["text"].to_pylist():
                words, first = sentences(text)
                each = [_features(w.decode()) for w in words]
                upto = np.concatenate([[0], np.cumsum([len(f) for f in each])]).astype(np.int64)
                features.append(np.array([f for e in each for f in e], np.int32).tobytes())
                starts.append(upto[first].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch["order"], batch["label"], pa.array(features, pa.binary()), pa.array(starts, pa.binary())],
                names=["order", "label", "features", "starts"],
            )

    return rows.mapInArrow(run, "order bigint, label int, features binary, starts binary")


def _segments(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the stretches that begin at ``starts``; stretches may be empty."""
    upto = np.concatenate([[0.0], np.cumsum(values)])
    return upto[np.append(starts[1:], len(values))] - upto[starts]


def fit(labels: list[int], features: list[np.ndarray], starts: list[np.ndarray]) -> tuple[np.ndarray, float]:
    """Weights of the features and the bias, by gradient descent on the noisy-or likelihood of the labels."""
    size = 1 << BITS
    weights, bias = np.zeros(size), START
    y = np.array(labels, dtype=np.float64)
    n_docs = len(y)
    often = np.zeros(size, np.int64)
    for label, f in zip(labels, features):
        if label:
            often[np.unique(f)] += 1
    used = often >= MIN_DOCS
    offset = np.cumsum([0, *map(len, features)])
    sentence_doc = np.repeat(np.arange(n_docs), [len(s) for s in starts])
    if not n_docs or not y.any() or not len(sentence_doc):
        return weights.astype(np.float32), bias
    feature = np.concatenate(features)
    first = np.concatenate([s + o for s, o in zip(starts, offset)])
    sentence = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(feature))))
    keep = used[feature]
    feature, sentence = feature[keep], sentence[keep]
    moment, square = np.zeros(size + 1), np.zeros(size + 1)
    for turn in range(1, ROUNDS + 1):
        logits = bias + np.bincount(sentence, weights=weights[feature], minlength=len(first))
        none = np.bincount(sentence_doc, weights=-np.logaddexp(0, logits), minlength=n_docs)  # log of no toxic sentence
        p = np.exp(-np.logaddexp(0, -logits))
        any_ = np.maximum(-np.expm1(none), 1e-12)
        slope = np.where(y > 0, -np.exp(none) / any_, 1.0)[sentence_doc] * p / n_docs
        grad = np.append(np.bincount(feature, weights=slope[sentence], minlength=size) + DECAY * weights, slope.sum())
        moment = 0.9 * moment + 0.1 * grad
        square = 0.99 * square + 0.01 * grad * grad
        step = RATE * (moment / (1 - 0.9**turn)) / (np.sqrt(square / (1 - 0.99**turn)) + 1e-8)
        weights -= step[:-1]
        bias -= step[-1]
    return weights.astype(np.float32), float(bias)


def held_out(id_: Column) -> Column:
    """Rows that are never learned from. Fixed by the contract; a null id counts as empty."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit(""))) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = TRAIN_ROWS):
    """The model, fitted in one task on at most ``most`` labelled documents that are not held out, chosen by a hash of their id."""
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    known = known.withColumn("order", F.xxhash64(F.col("id").cast("string"))).orderBy("order", "id").limit(most)
    known = materialize(known, "training_labels")
    rows = text_rows(docs.filter(F.col(id_col).isNotNull()), id_col, text_col).join(F.broadcast(known), "id")  # at most ``most`` rows
    chosen = rows.orderBy("order").limit(most)  # ids may repeat

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("order", "ascending"), ("features", "ascending")])
        features = [np.frombuffer(x, np.int32) for x in table["features"].to_pylist()]
        starts = [np.frombuffer(x, np.int64) for x in table["starts"].to_pylist()]
        weights, bias = fit(table["label"].to_pylist(), features, starts)
        return pa.table({"weights": pa.array([weights.tobytes()], pa.binary()), "bias": pa.array([bias])})

    examples = _examples(chosen.select("order", "label", "text"))
    found = examples.groupBy().applyInArrow(run, "weights binary, bias double").first()
    if found is None:
        return np.zeros(1 << BITS, np.float32), START
    return np.frombuffer(found["weights"], np.float32), found["bias"]


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``score``, ``n_sentences`` and ``offending``: ``start:stop`` (code points) of the sentences that reach the threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS weights

    def run(batches):
        weights, bias = sent.value
        words_of = _Words(np.asarray(weights, np.float64))
        for batch in batches:
            scores, counts, offending = [], [], []
            for text in batch["text"].to_pylist():
                if len(words_of) > _Words.MOST:
                    words_of = _Words(words_of.model)
                words, starts = sentences(text)
                rows = np.fromiter(map(words_of.__getitem__, words), np.int64, len(words))
                logits = _segments(words_of.weights[rows], starts) + bias if len(starts) else np.zeros(0)
                p = noisy_or(logits)
                scores.append(round(min(max(p, 0.0), 1.0), 6))
                counts.append(len(starts))
                bad = np.flatnonzero(logits > np.log(THRESHOLD / (1 - THRESHOLD))) if p >= THRESHOLD else []
                spans = ""
                if len(bad):
                    at = [m.span() for m in _WORD.finditer(text)]
                    stops = np.append(starts[1:], len(words))
                    spans = ",".join(f"{at[starts[i]][0]}:{at[stops[i] - 1][1]}" for i in bad)
                offending.append(spans)
            arrays = [batch["id"], pa.array(scores, pa.float64()), pa.array(counts, pa.int64()), pa.array(offending, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "score", "n_sentences", "offending"])

    schema = f"id {type_of(docs, id_col)}, score double, n_sentences bigint, offending string"
    return text_rows(docs, id_col, text_col).mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Score of every row of ``docs``.

    ``id_col``, ``held_out``, ``score``, ``predicted`` (1 from 0.3 on), ``n_sentences`` and ``offending``. Null and empty
    texts have no sentence and score 0. Without labelled documents no word is known and scores stay near 0.
    Labels that are null or not 0 or 1 are not used; of repeated labels the larger counts.
    """
    with job(docs.sparkSession) as scope:
        model = train(docs, labels, id_col, text_col, label_col)
        scored = score(docs, model, id_col, text_col)
        predicted = F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted")
        result = scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", predicted, "n_sentences", "offending")
        return scope.keep(materialize(result, "toxicity"))
