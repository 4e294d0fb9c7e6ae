"""Benchmark decontamination on templates: numbers, names and units become typed placeholders.

Windows of template words are hashed and joined with those of the benchmark. Windows that meet on the
same alignment of a document and an item are then checked together: each slot value of the item must
stand for one value in the document and the other way round, so a question with other numbers or names
is caught and a chance meeting of placeholders is not. Windows of the words as they are, in lower case,
meet too, so a copy is found in any case and however many numbers and names it has.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediatrends.llm.common import job, materialize, row_key, text_rows, type_of, unused

WINDOW = 8  # template words in a window; a shorter item is one window
PHRASE = 4  # an item of this many words up to a window meets whole sentences and lines only, a shorter one whole texts only
LITERALS = 5  # a window of a template has at least this many words that are no placeholders, or as many as the item has words
SHARE = 0.3  # of an item's windows that must meet, with consistent slots,
ENOUGH = 6  # or as many windows: 13 words in a row

# The windows of a benchmark are sent to all tasks up to this many (8 bytes each); beyond it the windows
# of the documents are shuffled instead.
SHIP_WINDOWS = 4_000_000

# Words that measure, taken as units after a number.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg t ton tons oz lb lbs pound pounds ml cl l liter liters litre "
    "litres gallon gallons ms s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "percent dollar dollars euro euros cent cents kmh mph hz khz mhz ghz w kw mw v kv a j kj cal kcal pa kpa bar c f k"
).split()

_PLAIN, _NUMBER, _UNIT = 0, 1, 2
_BLANK, _CAPITAL, _ENDS = -1, 4, 8
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»„“”‘’…–—¿¡"
_EDGE_BYTES = _EDGES.encode("ascii", "ignore")
_DIGITS = b"0123456789"
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_UNIT_SET = frozenset(u.encode() for u in UNITS)

NUMBER, NAME, UNIT = (np.uint64(xxhash.xxh3_64_intdigest(b"\0" + kind)) for kind in (b"number", b"name", b"unit"))


class _Words(dict):
    """Row of each written word in the tables ``hashes`` and ``kinds``, filled as words are met."""

    MOST = 500_000

    def __init__(self) -> None:
        super().__init__()
        self.hashes = np.zeros(self.MOST, np.uint64)
        self.kinds = np.zeros(self.MOST, np.int8)

    def __missing__(self, raw: bytes) -> int:
        row = len(self)
        if row == len(self.kinds):
            self.hashes = np.concatenate([self.hashes, np.zeros(row, np.uint64)])
            self.kinds = np.concatenate([self.kinds, np.zeros(row, np.int8)])
        if raw.isalpha() and raw.islower():  # ASCII only: the most frequent case
            self.hashes[row] = xxhash.xxh3_64_intdigest(raw)
            self.kinds[row] = _UNIT if raw in _UNIT_SET else _PLAIN
            self[raw] = row
            return row
        if raw.isascii():
            core = raw.strip(_EDGE_BYTES)
            low = core.lower()
        else:
            core = raw.decode().strip(_EDGES)
            low = core.lower().encode()
        if not low:
            kind = _BLANK
        else:
            kind = _PLAIN
            if len(low.translate(None, _DIGITS)) < len(low):
                kind = _NUMBER
            elif low in _UNIT_SET:
                kind = _UNIT
            if core[:1].isupper() and len(core) > 1 and core[1:] == core[1:].lower():
                kind |= _CAPITAL
            if raw[-1:] in b".!?:;" or raw[-1:] in b"\"')]" and raw[-2:-1] in b".!?":
                kind |= _ENDS
        self.hashes[row] = xxhash.xxh3_64_intdigest(low)
        self.kinds[row] = kind
        self[raw] = row
        return row


class Canonical:
    """Turns texts into arrays of template hashes; keeps the words it has met."""

    def __init__(self) -> None:
        self.words = _Words()

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray, np.ndarray]:
        """Template hash of each word, whether it is literal, the words as written, the hash of each in lower case, and
        whether a sentence or line begins with it."""
        if len(self.words) > _Words.MOST:
            self.words = _Words()  # forget, so that memory stays bounded
        # the end of a line ends a sentence
        raw = text.replace("\n", " .\n").encode().split()
        rows = np.fromiter(map(self.words.__getitem__, raw), dtype=np.int64, count=len(raw))
        kinds = self.words.kinds[rows]
        # a word without letters ends a sentence if it is a stop; other marks are passed over
        blank = kinds == _BLANK
        stop = np.zeros(len(raw) + 1, dtype=bool)
        stop[1:] = (kinds > 0) & (kinds & _ENDS > 0)
        stop[0] = True
        if blank.any():
            stop[1:][blank] = [r[-1:] in b".!?" for r in np.array(raw, dtype=object)[blank]]
            kept = np.flatnonzero(~blank)
            # a sentence begins at a word if a stop stands between it and the word before
            stops = np.concatenate([[0], np.cumsum(stop)])
            last = np.concatenate([[0], kept[:-1] + 1]) if len(kept) else kept
            begins = stops[kept + 1] > stops[last]
            raw = [raw[i] for i in kept.tolist()]
            rows, kinds = rows[kept], kinds[kept]
        else:
            begins = stop[:-1]
        hashes = self.words.hashes[rows]
        base = kinds & 3
        after_number = np.concatenate([[False], base[:-1] == _NUMBER])
        name = (kinds & _CAPITAL > 0) & ~begins & (base != _NUMBER)
        unit = (base == _UNIT) & after_number
        literal = ~((base == _NUMBER) | name | unit)
        plain = hashes
        hashes = np.where(base == _NUMBER, NUMBER, np.where(unit, UNIT, np.where(name, NAME, plain)))
        return hashes, literal, raw, plain, begins


def _mixed(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` words from each position on, by windows of twice the words in each step."""
    n = len(hashes) - width + 1
    out, done, block, held = np.full(n, width, np.uint64), 0, 1, hashes
    while done < width:
        if width & block:
            out = (out ^ held[done : done + n]) * _PRIME
            out ^= out >> np.uint64(29)
            done += block
        if done < width:
            pairs = held[:-block] * _PRIME
            pairs ^= pairs >> np.uint64(29)
            held, block = (pairs ^ held[block:]) * _PRIME, 2 * block
    return out


def windows(hashes: np.ndarray, plain: np.ndarray, literal: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By position, of windows of ``width`` words: the template hash, whether it has enough literal words, whether it
    has slots, and the hash of the words as they are, in lower case. The two hashes are equal where there is no slot."""
    mixed = _mixed(hashes, width)
    if literal.all():
        every = np.ones(len(mixed), bool)
        return mixed, every, ~every, mixed
    sums = np.concatenate([[0], np.cumsum(literal)])
    count = sums[width:] - sums[:-width]
    return mixed, count >= min(LITERALS, width), count < width, _mixed(plain, width)


def _slots(position: int, width: int, literal: np.ndarray, raw: list[bytes]) -> list[str]:
    return [raw[i].decode().strip(_EDGES).lower() for i in range(position, position + width) if not literal[i]]


_FOUND = "window bigint, position int, slots array<string>"


def _windows_of(rows: DataFrame, id_type: str, wanted: np.ndarray | None = None, widths: list[int] | None = None) -> DataFrame:
    """Windows of the texts; with ``wanted`` (sorted) only those whose hash is in it.

    Without ``widths`` the texts are items, of one width each; their windows tell whether the template has enough literal
    words (``judged``), how many have, and the number of all. Documents have windows of all ``widths``; those narrower than
    ``WINDOW`` must be a whole sentence or line, and those below ``PHRASE`` words the whole text, as a few common words
    say nothing about where they come from.
    """
    items = widths is None

    def among(hashes: np.ndarray) -> np.ndarray:
        if wanted is None:
            return np.ones(len(hashes), bool)
        return wanted[np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)] == hashes

    def run(batches):
        canonical = Canonical()
        for batch in batches:
            ids, found, positions, slots, more = [], [], [], [], []
            for i, text in enumerate(batch["text"].to_pylist()):
                hashes, literal, raw, plain, begins = canonical(text)
                for width in [min(WINDOW, len(hashes))] if items else widths:
                    if not 0 < width <= len(hashes) or (not items and width < PHRASE and width < len(hashes)):
                        continue
                    mixed, good, slotted, exact = windows(hashes, plain, literal, width)
                    whole = np.ones(len(mixed), bool)
                    if not items and width < WINDOW:
                        # a sentence or line begins with the window, and the next one behind it
                        whole = begins[: len(mixed)] & np.append(begins, True)[width:]
                    at = np.flatnonzero(good & whole & among(mixed))
                    words = np.flatnonzero(slotted & whole)
                    words = words[among(exact[words])]
                    if not len(at) and not len(words):
                        continue
                    ids += [i] * (len(at) + len(words))
                    positions += [*at.tolist(), *words.tolist()]
                    found += [mixed[at], exact[words]]
                    slots += [_slots(p, width, literal, raw) if slotted[p] else [] for p in at.tolist()] + [[]] * len(words)
                    if items:
                        more += [(bool(good[p]), int(good.sum()), len(mixed), width) for p in (*at.tolist(), *words.tolist())]
            arrays = [
                *(batch[c].take(pa.array(ids, pa.int64())) for c in ("id", "text_key")),
                pa.array(np.concatenate(found).view(np.int64) if found else [], pa.int64()),
                pa.array(positions, pa.int32()),
                pa.array(slots, pa.list_(pa.string())),
            ]
            names = ["id", "text_key", "window", "position", "slots"]
            if items:
                kinds = (pa.bool_(), pa.int32(), pa.int32(), pa.int32())
                arrays += [pa.array([m[k] for m in more], kind) for k, kind in enumerate(kinds)]
                names += ["judged", "n_judged", "n_windows", "width"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    rows = rows.withColumn("text_key", F.xxhash64("text"))
    return rows.mapInArrow(run, f"id {id_type}, text_key bigint, {_FOUND}" + ", judged boolean, n_judged int, n_windows int, width int" * items)


def _matches(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str) -> DataFrame:
    """Pairs of a document, which is an ``id`` and a ``text_key``, and an ``item``, with the ``best`` alignment of the two."""
    id_type, item_type = type_of(docs, id_col), type_of(benchmark, item_col)
    items = materialize(_windows_of(text_rows(benchmark, item_col, item_text), item_type), "item_windows")
    widths = sorted(r["width"] for r in items.select("width").distinct().collect())  # at most WINDOW
    hashes = items.select("window").distinct()
    n = hashes.count()
    wanted = None
    if 0 < n <= SHIP_WINDOWS:
        wanted = np.sort(np.array([r[0] for r in hashes.collect()], dtype=np.int64).view(np.uint64))
    found = materialize(_windows_of(text_rows(docs, id_col, text_col), id_type, wanted, widths), "document_windows")
    known = items.select(
        F.col("id").alias("item"), F.col("text_key").alias("item_key"), "judged", "n_judged", "n_windows", "window", F.col("position").alias("at"), F.col("slots").alias("values")
    )
    met = found.join(known, "window").withColumn("shift", F.col("position") - F.col("at"))
    # by alignment: which windows of the item meet, and which values meet in its slots
    pairs = F.transform(F.arrays_zip("values", "slots"), lambda p: F.struct(p["values"].alias("item"), p["slots"].alias("own")))
    keys = ["id", "text_key", "item", "item_key", "n_judged", "n_windows", "shift"]
    window = F.struct("at", "position", "judged", pairs.alias("pairs"))
    aligned = met.groupBy(*keys).agg(F.collect_set(window).alias("met"))  # at most two for each window of one item
    aligned = aligned.withColumn("pairs", F.array_distinct(F.flatten("met.pairs")))
    # a value of one side that stands for two of the other spoils the windows that hold it, not the others
    clash = F.filter("pairs", lambda p: F.exists("pairs", lambda q: (q["item"] == p["item"]) != (q["own"] == p["own"])))
    aligned = aligned.withColumn("clash", clash)
    aligned = aligned.withColumn("met", F.filter("met", lambda m: ~F.arrays_overlap(m["pairs"], F.col("clash"))))
    aligned = aligned.withColumn("n_matched", F.size(F.array_distinct("met.at")))
    n_judged = F.size(F.array_distinct(F.transform(F.filter("met", lambda m: m["judged"]), lambda m: m["at"])))
    enough = lambda total: F.least(F.lit(SHARE) * total, F.lit(float(ENOUGH)))
    good = aligned.filter(
        ((n_judged > 0) & (n_judged >= enough(F.col("n_judged")))) | ((F.col("n_matched") > 0) & (F.col("n_matched") >= enough(F.col("n_windows"))))
    )
    changed = F.size(F.filter(F.array_distinct(F.flatten("met.pairs")), lambda p: p["item"] != p["own"])).alias("n_changed")
    best = F.struct((-F.col("n_matched")).alias("order"), F.array_min("met.position").alias("position"), "n_matched", changed, "n_windows")
    return good.groupBy("id", "text_key", "item").agg(F.min(best).alias("best"))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """Pairs of a document and a benchmark item that it contains, wholly or for a large part.

    ``id_col``, ``item_col``, ``n_matched`` and ``n_windows`` (windows of the item that meet, and all of them), ``position``
    (first matching word of the document) and ``n_changed`` (slots whose value differs). Clean documents are not listed.
    Null and empty texts match nothing; items that repeat are matched each; a document is listed once for each id, by the
    text that matches best. A text of any length is compared whole. Items of fewer than ``WINDOW`` words are found where they
    are a sentence or line of their own, and those of fewer than ``PHRASE`` words where they are the whole text.
    """
    with job(docs.sparkSession) as scope:
        chosen = _matches(docs, benchmark, id_col, text_col, item_col, item_text).groupBy("id", "item").agg(F.min("best").alias("best"))
        result = chosen.select(
            F.col("id").alias(id_col), F.col("item").alias(item_col), "best.n_matched", "best.n_windows", "best.position", "best.n_changed"
        )
        return scope.keep(materialize(result, "contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item. Rows are judged by id and text, also those without an id.

    The items are found, the rows not yet computed.
    """
    with job(docs.sparkSession) as scope:
        matches = _matches(docs, benchmark, id_col, text_col, "item_id", "text")
        own_key, own_text, key, same_id, same_text = unused(docs, "row_key", "text_key", "found_key", "found_id", "found_text")
        found = matches.select(F.col("id").alias(same_id), F.col("text_key").alias(same_text)).distinct()
        found = scope.keep(materialize(found.withColumn(key, row_key(F.col(same_id), F.col(same_text))), "contaminated"))
    rows = docs.withColumn(own_text, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    rows = rows.withColumn(own_key, row_key(F.col(id_col), F.col(own_text)))
    same = (F.col(own_key) == F.col(key)) & F.col(id_col).eqNullSafe(F.col(same_id)) & (F.col(own_text) == F.col(same_text))
    return rows.join(found, same, "left_anti").select(*docs.columns)
