"""Secrets: fixed patterns, and a linear-chain conditional random field that finds further ones.

The field tags each token as begin, inside or outside of a secret. Its features are the token's shape, the neighbouring
words and features of the whole file. It learns from windows around the matches of the fixed patterns and around other
places; half of the windows hide the neighbours, so that a shape alone can tell a secret, too. Windows in which a first
field, of shapes alone, suspects a secret that no pattern names are not learned from. Texts are decoded by Viterbi. Scores of a token depend on its words alone, so they are looked up; a token whose score for outside leads by
more than any transitions could win back is outside on every best path, and only the stretches between such tokens are
searched.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediatrends.llm.common import job, materialize, text_rows, type_of

# Fixed by the contract.
KINDS = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]{32,}"),  # runs are maximal, so shorter ones may be passed over at once
}
LEAST = {"assign": 8, "access": 16, "hex": 32}
NAMED = {"assign": ("password", "passwd", "secret", "token", "api"), "access": ("akia",)}
FOUND = "secret"  # kind of the spans that the field adds

TOKEN = re.compile(r"[\w+/-]+(?:\.[\w+/-]+)*|[^\w\s+/-]+")
PIECE = 1 << 20  # characters cut into tokens at a time

BEGIN, INSIDE, OUTSIDE = 0, 1, 2
ROLES = ("own", "one before", "two before", "three before", "one after")
_SHIFTS = (0, 1, 2, 3, -1)
# Features of a token's own, of a neighbour, and of a token with its neighbours; of the file.
OWN, NEAR = 12, 2
WORD_FEATURES, FILE_FEATURES = OWN + NEAR * (len(ROLES) - 1), 3

# The sample to learn from: a window of tokens each of at most so many texts with a secret, and of as many without.
WINDOW, REACH = 24, 10
SAMPLE = 1500
EPOCHS, STEP, SHRINK = 40, 0.3, 1e-5
RARE = 8
# A window without a match teaches nothing if it seems to hold a secret with this chance: no pattern knows all secrets.
DOUBT = 0.2
SPAN = "struct<kind:string,start:int,stop:int>"
CACHED, CACHED_CHARS = 600_000, 1 << 26


def base_spans(text: str) -> list[tuple[str, int, int, int]]:
    """Kind, start and stop of the matches of the fixed patterns, and where their secret part begins; by start, then kind."""
    found, low = [], text.lower()
    for place, (kind, pattern) in enumerate(KINDS.items()):
        if kind in NAMED and not any(name in low for name in NAMED[kind]):
            continue  # the pattern needs one of these, and looking for them is cheap
        for m in pattern.finditer(text):
            secret = m.start(2) if kind == "assign" else m.start()
            if m.end() - secret >= LEAST[kind]:
                found.append((m.start(), place, kind, m.end(), secret))
    return [(kind, start, stop, secret) for start, _, kind, stop, secret in sorted(found)]


def _bucket(number: int) -> int:
    return min(int(math.log2(number + 1) * 2), 15)


_SIZES = [f"size {_bucket(n)}" for n in range(256)]


def _size(token: str) -> str:
    return _SIZES[min(len(token), 255)]


def shape(token: str) -> str:
    """Classes of the characters, runs as one: upper A, lower a, digit 9, other letters x, marks as they are."""
    kinds = ["A" if c.isupper() else "a" if c.islower() else "9" if c.isdigit() else "x" if c.isalpha() else c for c in token]
    return "".join(k for k, before in zip(kinds, ["", *kinds]) if k != before)


def _written(token: str, low: str) -> str | None:
    """How a token of letters is written, if it is written like a word."""
    if low == token:
        return "plain"
    if token[1:] == low[1:]:
        return "capital"
    return "upper" if token.isupper() else None


def _features(token: str) -> tuple[list[str], list[str]]:
    """Features of a token for itself, and for its neighbours."""
    low, size = token.lower(), _size(token)
    word = f"word {low}" if len(low) <= 24 else "long word"
    written = _written(token, low) if token.isalpha() else None
    if written:
        return [written, size, f"{written} {size}"], [word, written]
    form = shape(token)
    digits = sum(map(str.isdigit, token))
    letters = sum(map(str.isalpha, token))
    often = Counter(token)
    entropy = -sum(n / len(token) * math.log2(n / len(token)) for n in often.values())
    mixed = digits > 0 and letters > 0
    hexed = all(c in "0123456789abcdef" for c in low)
    own = [
        size, f"form {form[:8]}", f"turns {_bucket(len(form))}", f"turns {_bucket(len(form))} {size}", f"digits {10 * digits // len(token)}",
        f"entropy {int(2 * entropy)}", f"entropy {int(2 * entropy)} {size}", f"mixed {mixed} {size}", f"hex {hexed} {size}", f"case {low == token} {token.upper() == token} {mixed}",
        f"start {token[:4]}" if len(token) > 4 else word, f"marks {''.join(sorted(set(form) - set('Aa9x')))[:6]}",
    ]
    return own, [word, f"form {form[:8]}"]


def _id(feature: str, role: int) -> int:
    """The number of a feature in a role; 0 is left for padding."""
    return (xxhash.xxh32_intdigest(feature) + role * 0x9E3779B1) & 0xFFFFFFFF or 1


def _ids(features: list[str], role: int) -> list[int]:
    return [_id(f, role) for f in features]


def word_ids(token: str) -> list[list[int]]:
    """Feature numbers of a token by role."""
    own, near = _features(token)
    return [_ids(own, 0), *(_ids(near, role) for role in range(1, len(ROLES)))]


def file_ids(text: str) -> list[int]:
    """Features of the whole file: how dense its lines and its marks of code are, and its size."""
    size = len(text) + 1
    lines, marks = text.count("\n") + 1, sum(map(text.count, "{}=;<>"))
    return _ids([f"lines {_bucket(1000 * lines // size)}", f"code {_bucket(1000 * marks // size)}", f"size {_bucket(size) // 3}"], len(ROLES))


def _pieces(text: str) -> Iterator[tuple[int, str]]:
    """The text cut behind blanks, so that no token is cut."""
    start = 0
    while start < len(text):
        stop = start + PIECE
        while stop < len(text) and not text[stop - 1].isspace():
            stop += 1
        yield start, text[start:stop]
        start = stop


def token_places(text: str) -> np.ndarray:
    """Start and stop of every token of the whole text, as rows."""
    found = [np.array([m.span() for m in TOKEN.finditer(piece)], np.int64).reshape(-1, 2) + at for at, piece in _pieces(text)]
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def token_tags(places: np.ndarray, spans: list[tuple[str, int, int, int]]) -> np.ndarray:
    """Tags of the tokens: those that meet the secret part of a span are inside, the first of them begins."""
    tags = np.full(len(places), OUTSIDE, np.int8)
    for _, _, stop, secret in spans:
        first, last = np.searchsorted(places[:, 1], secret, side="right"), np.searchsorted(places[:, 0], stop)
        if first < last and (tags[first:last] == OUTSIDE).all():
            tags[first:last] = INSIDE
            tags[first] = BEGIN
    return tags


def _window(text: str, places: np.ndarray, tags: np.ndarray, start: int) -> tuple[bytes, bytes]:
    """Feature numbers (``WINDOW`` x ``WORD_FEATURES`` + file features, padded with zero) and tags of a window."""
    stop = min(start + WINDOW, len(places))
    ids = np.zeros((WINDOW, WORD_FEATURES + FILE_FEATURES), np.uint32)
    held = [word_ids(text[a:b]) for a, b in places[max(0, start - 3) : stop + 1].tolist()]
    own = start - max(0, start - 3)
    for i in range(stop - start):
        for role, shift in enumerate(_SHIFTS):
            at = own + i - shift
            if 0 <= at < len(held):
                column = OWN + NEAR * (role - 1) if role else 0
                ids[i, column : column + len(held[at][role])] = held[at][role]
    ids[: stop - start, WORD_FEATURES:] = file_ids(text)
    return ids.tobytes(), np.pad(tags[start:stop], (0, WINDOW - stop + start), constant_values=-1).tobytes()


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each text, and whether a fixed pattern matches."""
    for batch in batches:
        secret = pa.array([bool(base_spans(t)) for t in batch["text"].to_pylist()], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch["rank"], secret], names=["rank", "secret"])


def _windows(least: dict[bool, int]):
    """A window each of the texts whose hash is at most that in ``least``, by whether a fixed pattern matches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for rank, text in zip(batch["rank"].to_pylist(), batch["text"].to_pylist()):
                spans = base_spans(text)
                places = token_places(text) if rank <= least[bool(spans)] else []
                if not len(places):
                    continue
                tags = token_tags(places, spans)
                begins = np.flatnonzero(tags == BEGIN)
                if spans and not len(begins):
                    continue
                at = begins[rank % len(begins)] if spans else rank % len(places)
                rows.append((bool(spans), rank, *_window(text, places, tags, max(0, int(at) - REACH))))
            columns = zip(*rows) if rows else [[]] * 4
            kinds = (pa.bool_(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["secret", "rank", "ids", "tags"])

    return run


class Field:
    """Weights of features by tag, of transitions, and of the tags at the edges of a text.

    ``ids`` are the numbers of the known features, sorted; the first is 0, which stands for no feature.
    """

    def __init__(self) -> None:
        self.ids, self.weights = np.zeros(1, np.uint32), np.zeros((1, 3))
        self.steps = np.zeros((3, 3))
        self.first, self.last = np.zeros(3), np.zeros(3)

    def rows(self, ids: np.ndarray) -> np.ndarray:
        """The rows of ``weights`` of features; unknown ones have the row of none."""
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return np.where(self.ids[at] == ids, at, 0)

    def _passes(self, scores: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward scores of windows by token and tag, and the sum over all paths."""
        width = scores.shape[1]
        forward, backward = np.zeros_like(scores), np.zeros_like(scores)
        forward[:, 0] = scores[:, 0] + self.first
        for t in range(1, width):
            step = _log_sum(forward[:, t - 1, :, None] + self.steps, 1) + scores[:, t]
            forward[:, t] = np.where(inside[:, t, None], step, forward[:, t - 1])
        backward[:, -1] = self.last
        for t in range(width - 2, -1, -1):
            step = _log_sum(self.steps + (scores[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(inside[:, t + 1, None], step, self.last)
        return forward, backward, _log_sum(forward[:, -1] + self.last, 1)

    def fit(self, ids: np.ndarray, tags: np.ndarray) -> Field:
        """Maximum likelihood by adaptive gradient steps; ``ids`` is windows x tokens x features, ``tags`` -1 behind the end."""
        n, width, _ = ids.shape
        inside = tags >= 0
        rows, ends = np.arange(n), inside.sum(axis=1) - 1
        truth = np.zeros((n, width, 3))
        truth[inside, tags[inside]] = 1
        follows = inside[:, 1:]
        seen_steps = np.zeros((3, 3))
        np.add.at(seen_steps, (tags[:, :-1][follows], tags[:, 1:][follows]), 1)
        seen_first, seen_last = truth[:, 0].sum(axis=0), truth[rows, ends].sum(axis=0)
        used, place, often = np.unique(ids, return_inverse=True, return_counts=True)
        # a feature of few tokens would only learn them by heart
        ids = np.where(often[place.reshape(ids.shape)] >= RARE, ids, 0)
        used, place = np.unique(np.append(ids, np.uint32(0)), return_inverse=True)
        place = place[:-1].reshape(ids.shape)
        own = np.zeros((len(used), 3))
        state = [np.full_like(own, 1e-6), np.full((3, 3), 1e-6), np.full(3, 1e-6), np.full(3, 1e-6)]
        columns = [np.ascontiguousarray(place[:, :, k]) for k in range(ids.shape[2])]
        for _ in range(EPOCHS):
            scores = _summed(own, columns)
            forward, backward, total = self._passes(scores, inside)
            chance = np.exp(forward + backward - total[:, None, None]) * inside[:, :, None]
            pairs = np.zeros((3, 3))
            for t in range(1, width):
                step = forward[:, t - 1, :, None] + self.steps + (scores[:, t] + backward[:, t])[:, None, :] - total[:, None, None]
                pairs += np.exp(np.minimum(step[follows[:, t - 1]], 0)).sum(axis=0)
            off = truth - chance
            gradient = sum(np.stack([np.bincount(c.ravel(), off[:, :, k].ravel(), len(used)) for k in range(3)], axis=1) for c in columns) / n
            gradients = [gradient - SHRINK * own, (seen_steps - pairs) / n, (seen_first - chance[:, 0].sum(axis=0)) / n, (seen_last - chance[rows, ends].sum(axis=0)) / n]
            for value, g, s in zip((own, self.steps, self.first, self.last), gradients, state):
                s += g * g
                value += STEP * g / np.sqrt(s)
            own[0] = 0  # padding
        self.ids, self.weights = used, own
        return self

    def doubtful(self, ids: np.ndarray, tags: np.ndarray) -> np.ndarray:
        """Whether a window has a token tagged outside that the field takes for a secret with some chance."""
        columns = [self.rows(ids[:, :, k]) for k in range(ids.shape[2])]
        forward, backward, total = self._passes(_summed(self.weights, columns), tags >= 0)
        outside = np.exp(forward[:, :, OUTSIDE] + backward[:, :, OUTSIDE] - total[:, None])
        return ((tags == OUTSIDE) & (1 - outside > DOUBT)).any(axis=1)

    def leads(self) -> np.ndarray:
        """What ``BEGIN`` and ``INSIDE`` can win over ``OUTSIDE`` by the steps to and from any neighbours, or the edges."""
        into, out = np.vstack([self.steps, self.first]), np.vstack([self.steps.T, self.last])
        return np.array([(into[:, s] - into[:, OUTSIDE]).max() + (out[:, s] - out[:, OUTSIDE]).max() for s in (BEGIN, INSIDE)])

    def viterbi(self, scores: np.ndarray, before: np.ndarray, after: np.ndarray) -> list[int]:
        """The best tags of a stretch; ``before`` and ``after`` are the step scores at its edges."""
        steps, back = self.steps.tolist(), []
        best = [float(s + b) for s, b in zip(scores[0], before)]
        for row in scores[1:].tolist():
            came, reached = [], []
            for tag in range(3):
                options = [best[k] + steps[k][tag] for k in range(3)]
                k = max(range(3), key=options.__getitem__)
                came.append(k)
                reached.append(options[k] + row[tag])
            back.append(came)
            best = reached
        tag = max(range(3), key=lambda k: best[k] + after[k])
        tags = [tag]
        for came in reversed(back):
            tag = came[tag]
            tags.append(tag)
        return tags[::-1]

    def decode(self, scores: np.ndarray) -> np.ndarray:
        """The best tags of a whole text from its scores by token and tag."""
        tags = np.full(len(scores), OUTSIDE, np.int8)
        lead = self.leads()
        unsure = (scores[:, OUTSIDE, None] - scores[:, [BEGIN, INSIDE]] <= lead + 1e-9).any(axis=1)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], unsure, [False]]).astype(np.int8)))
        for start, stop in zip(edges[::2].tolist(), edges[1::2].tolist()):
            before = self.first if start == 0 else self.steps[OUTSIDE]
            after = self.last if stop == len(scores) else self.steps[:, OUTSIDE]
            tags[start:stop] = self.viterbi(scores[start:stop], before, after)
        return tags


def _summed(weights: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
    """The scores of the tags by token, from the numbers of its features, a column at a time."""
    scores = weights[columns[0]]
    for column in columns[1:]:
        scores += weights[column]
    return scores


def _log_sum(values: np.ndarray, axis: int) -> np.ndarray:
    top = values.max(axis=axis, keepdims=True)
    return np.log(np.exp(values - top).sum(axis=axis)) + top.squeeze(axis)


class _Scores(dict):
    """Row of each token in the table ``rows`` of its scores by role and tag, filled as tokens are met.

    Tokens that are written like words and that the field does not know share the row of their writing and size.
    """

    def __init__(self, field: Field) -> None:
        super().__init__()
        self.weights, self.chars, self.used = field.weights, 0, 0
        self.known = {int(i): row for row, i in enumerate(field.ids.tolist())}
        self.rows = np.zeros((1 << 12, len(ROLES), 3))
        self.shared: dict[tuple[str, str], int] = {}

    def _new(self, token: str) -> int:
        if self.used == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        for role, ids in enumerate(word_ids(token)):
            self.rows[self.used, role] = self.weights[[self.known.get(i, 0) for i in ids]].sum(axis=0)
        self.used += 1
        return self.used - 1

    def __missing__(self, token: str) -> int:
        row = None
        if token.isalpha():
            low = token.lower()
            written = _written(token, low)
            if written and len(low) <= 24:
                word = xxhash.xxh32_intdigest(f"word {low}")
                if not any(((word + role * 0x9E3779B1) & 0xFFFFFFFF) in self.known for role in range(1, len(ROLES))):
                    key = (written, _size(token))
                    row = self.shared.get(key)
                    if row is None:
                        row = self.shared[key] = self._new(token)
        if row is None:
            row = self._new(token)
        self.chars += len(token)
        self[token] = row
        return row


class Tagger:
    """Finds the spans of whole texts with a field; keeps the tokens it has met."""

    def __init__(self, field: Field) -> None:
        self.field = field
        self.words = _Scores(field)

    def scores(self, text: str) -> np.ndarray:
        """By token of the whole text: the score of each tag."""
        if len(self.words) > CACHED or self.words.chars > CACHED_CHARS:
            self.words = _Scores(self.field)  # forget, so that memory stays bounded
        found = []
        for _, piece in _pieces(text):
            tokens = TOKEN.findall(piece)
            found.append(np.fromiter(map(self.words.__getitem__, tokens), np.int32, len(tokens)))
        rows = np.concatenate(found) if found else np.zeros(0, np.int32)
        table = self.words.rows
        scores = table[rows, 0] + self.field.weights[self.field.rows(np.array(file_ids(text), np.uint32))].sum(axis=0)
        for role, shift in list(enumerate(_SHIFTS))[1:]:
            if shift > 0:
                scores[shift:] += table[rows[:-shift], role]
            else:
                scores[:shift] += table[rows[-shift:], role]
        return scores

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Start and stop of the secrets that the field finds."""
        scores = self.scores(text)
        if not len(scores):
            return []
        tags = self.field.decode(scores)
        inside = tags != OUTSIDE
        if not inside.any():
            return []
        places = token_places(text)
        begins = inside & ((tags == BEGIN) | ~np.concatenate([[False], inside[:-1]]))
        ends = inside & ~np.concatenate([inside[1:] & ~begins[1:], [False]])
        return list(zip(places[begins, 0].tolist(), places[ends, 1].tolist()))


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The field of all windows, in one task: their number and size are bounded."""
    rows = [r for batch in batches for r in batch.to_pylist()]
    if not rows:
        return
    ids = np.stack([np.frombuffer(r["ids"], np.uint32).reshape(WINDOW, -1) for r in rows])
    tags = np.stack([np.frombuffer(r["tags"], np.int8) for r in rows])
    alone = ids.copy()
    alone[:, :, OWN:WORD_FEATURES] = 0  # the same windows without the neighbours
    sure = ~Field().fit(alone, tags).doubtful(alone, tags) | np.array([r["secret"] for r in rows])
    field = Field().fit(np.concatenate([ids[sure], alone[sure]]), np.concatenate([tags[sure], tags[sure]]))
    held = [field.ids, field.weights, field.steps, field.first, field.last]
    yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in held], pa.binary())], names=["held"])


def learned_field(docs: DataFrame, text_col: str = "text") -> Field | None:
    """The field learned from a window each of ``SAMPLE`` texts with a match of the fixed patterns, and of as many without.

    The texts with the least hashes are taken, so that reruns agree; copies are taken once. Without a match anywhere there is
    nothing to learn: None.
    """
    texts = text_rows(docs, text_col, text_col).select("text", F.xxhash64("text").bitwiseAND((1 << 62) - 1).alias("rank"))
    judged = materialize(texts.mapInArrow(_judged, "rank bigint, secret boolean").distinct(), "judged")
    least = {}
    for secret in (True, False):
        chosen = judged.filter(F.col("secret") == secret).orderBy("rank").limit(SAMPLE)
        least[secret] = chosen.agg(F.max("rank")).first()[0]
    if least[True] is None:
        return None
    least = {k: -1 if v is None else v for k, v in least.items()}
    near = texts.filter(F.col("rank") <= max(least.values()))
    windows = near.mapInArrow(_windows(least), "secret boolean, rank bigint, ids binary, tags binary").dropDuplicates(["rank"])
    fitted = windows.repartition(1).sortWithinPartitions("rank").mapInArrow(_fitted, "held binary").collect()
    if not fitted:
        return None
    field = Field()
    kinds = [np.uint32, *[np.float64] * 4]
    arrays = [np.frombuffer(bytes(r["held"]), kind) for r, kind in zip(fitted, kinds)]
    field.ids, field.weights, field.steps, field.first, field.last = arrays[0], arrays[1].reshape(-1, 3), arrays[2].reshape(3, 3), *arrays[3:]
    return field


def _merged(base: list[tuple[str, int, int, int]], added: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """All spans by start, then kind; an added span that meets one of the fixed patterns is left out."""
    order = {k: i for i, k in enumerate([*KINDS, FOUND])}
    starts = np.array([s for _, s, _, _ in base], np.int64)
    reach = np.maximum.accumulate(np.array([e for _, _, e, _ in base], np.int64)) if base else starts
    found = [(k, a, b) for k, a, b, _ in base]
    for start, stop in added:
        before = int(np.searchsorted(starts, stop))  # spans that begin before this one ends
        if not before or reach[before - 1] <= start:
            found.append((FOUND, start, stop))
    return sorted(found, key=lambda s: (s[1], order[s[0]]))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``spans`` (kind, start, stop in code points) of the secrets in every row of ``docs``.

    Spans of the fixed patterns have their kinds, those that the field adds the kind ``secret``; they come by start, then kind.
    A null or empty text has none. Repeated rows get the same spans. An empty table gives an empty one. If no text
    matches a fixed pattern, the field has nothing to learn from and adds none. Texts of any length are tagged whole.
    """
    kind = type_of(docs, id_col)
    with job(docs.sparkSession) as scope:
        field = learned_field(docs, text_col)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tagger = Tagger(field) if field else None
            for batch in batches:
                spans = []
                for text in batch["text"].to_pylist():
                    all_ = _merged(base_spans(text), tagger.spans(text) if tagger else [])
                    spans.append([{"kind": k, "start": a, "stop": b} for k, a, b in all_])
                typed = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
                yield pa.RecordBatch.from_arrays([batch["id"], pa.array(spans, typed)], names=["id", "spans"])

        found = text_rows(docs, id_col, text_col).mapInArrow(run, f"id {kind}, spans array<{SPAN}>")
        return scope.keep(materialize(found.select(F.col("id").alias(id_col), "spans"), "secrets"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def secret_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The spans of ``secret_spans`` as counts by kind, a digest of those of the fixed patterns and a list of all."""
    found = secret_spans(docs, id_col, text_col)
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    counts = [F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in KINDS]
    base = F.filter("spans", lambda s: s["kind"] != FOUND)
    return found.select(id_col, *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), F.size(of(FOUND)).cast("bigint").alias("n_added"))
