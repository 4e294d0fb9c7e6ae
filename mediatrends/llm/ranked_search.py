"""Ranked lexical search with bit-sliced Bloom signatures.

Documents of similar length share a block. A block has as many bitmaps over its documents (slices) as a signature has
bits; bit b of a document is set if one of its terms hashes to b. The documents that may hold a term are the AND of its
slices: never too few, sometimes too many. A term is entered again for each level its count reaches, so the slices bound
counts too, and sums of weights over them bound the score of every document from above. A few documents with the greatest
bounds are scored exactly, which gives each item a score that 20 documents reach; all documents whose bound is not below
it are then scored exactly. No document is left out that could rank.

The index holds all terms of all documents and knows nothing of the items.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from mediatrends.llm.common import job, materialize, row_key, text_rows, type_of
from mediatrends.session import with_row_number

TOP = 20
SCALE = 1_000_000_000
BITS = 10  # bits of a signature for each entry of the longest document of the block
HASHES = 4
MOST_BITS = 1 << 22  # a longer signature would not fit in memory; a shorter one only loosens the bounds
ENTRIES = 1 << 19  # entries of a block
DOCUMENTS = 1024  # documents of a block
# Counts of terms are written out after so many terms or bytes of text.
LEXICON_TERMS, LEXICON_BYTES = 200_000, 1 << 26
ITEMS = 1000  # items answered in one pass over the index

# Counts that begin a level: 1, 2, 3, 4, 6, 8, 12, 16 and so on.
LEVELS = np.array([1, *(n for i in range(1, 24) for n in (1 << i, 3 << (i - 1)))], dtype=np.int64)

# A-Z become lower case; of ASCII only letters and digits belong to terms.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: str) -> list[bytes]:
    """The terms of the whole text, as UTF-8."""
    return text.encode().translate(_TERMS).split()


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def entry_hashes(hashes: np.ndarray, level: np.ndarray | int) -> np.ndarray:
    """One hash for a term (given by its hash) at a level."""
    return _mixed(hashes + (np.atleast_1d(np.asarray(level, np.uint64)) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def positions(hashes: np.ndarray, width: int) -> np.ndarray:
    """The ``HASHES`` bits of each entry in a signature of ``width`` bits."""
    low, high = hashes & np.uint64(0xFFFFFFFF), hashes >> np.uint64(32) | np.uint64(1)
    drawn = (low[:, None] + high[:, None] * np.arange(HASHES, dtype=np.uint64)) & np.uint64(0xFFFFFFFF)
    return ((drawn * np.uint64(width)) >> np.uint64(32)).astype(np.int64)


def entries(counts: Counter) -> np.ndarray:
    """Hashes of all entries of a document: each term at each level that its count reaches."""
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, counts), np.uint64, len(counts))
    reached = np.searchsorted(LEVELS, np.fromiter(counts.values(), np.int64, len(counts)), side="right")
    level = np.arange(reached.sum()) - np.repeat(np.cumsum(reached) - reached, reached)
    return entry_hashes(np.repeat(hashes, reached), level.astype(np.uint64))


def slices_of(documents: list[np.ndarray]) -> tuple[int, bytes]:
    """Signature width and slices of a block: for each bit, a bitmap over the documents."""
    width = min(MOST_BITS, max(64, BITS * max(map(len, documents))))
    bits = np.zeros((width, len(documents)), np.uint8)
    for place, found in enumerate(documents):
        bits[positions(found, width), place] = 1
    return width, np.packbits(bits, axis=1, bitorder="little").tobytes()


def _indexed(id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}  # by the power of two that their entries fill
        lexicon: Counter = Counter()
        read = 0

        def block(rows: list) -> pa.RecordBatch:
            width, held = slices_of([r[2] for r in rows])
            sizes, most = [r[3] for r in rows], [r[4] for r in rows]
            columns = {
                "ids": pa.array([[r[0] for r in rows]], pa.list_(id_type)), "text_keys": pa.array([[r[1] for r in rows]], pa.list_(pa.int64())),
                "sizes": pa.array([sizes], pa.list_(pa.int64())), "most": pa.array([most], pa.list_(pa.int64())), "n_terms": pa.array([sum(sizes)], pa.int64()),
                "width": pa.array([width], pa.int32()), "slices": pa.array([held], pa.large_binary()).cast(pa.binary()),
                "terms": pa.nulls(1, pa.list_(pa.binary())), "holding": pa.nulls(1, pa.list_(pa.int64())),
            }
            return pa.RecordBatch.from_pydict(columns)

        def counted() -> pa.RecordBatch:
            columns = {
                "ids": pa.nulls(1, pa.list_(id_type)), "text_keys": pa.nulls(1, pa.list_(pa.int64())), "sizes": pa.nulls(1, pa.list_(pa.int64())),
                "most": pa.nulls(1, pa.list_(pa.int64())), "n_terms": pa.nulls(1, pa.int64()), "width": pa.nulls(1, pa.int32()), "slices": pa.nulls(1, pa.binary()),
                "terms": pa.array([list(lexicon)], pa.list_(pa.binary())), "holding": pa.array([list(lexicon.values())], pa.list_(pa.int64())),
            }
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            for own, key, text in zip(*(batch[c].to_pylist() for c in ("id", "text_key", "text"))):
                words = terms(text)
                if not words:
                    continue
                counts = Counter(words)
                lexicon.update(counts.keys())
                read += len(text)
                found = entries(counts)
                size = max(6, len(found).bit_length())
                rows = waiting.setdefault(size, [])
                rows.append((own, key, found, len(words), max(counts.values())))
                if len(rows) >= DOCUMENTS or len(rows) << size >= ENTRIES:
                    yield block(waiting.pop(size))
                if len(lexicon) >= LEXICON_TERMS or read >= LEXICON_BYTES:
                    yield counted()
                    lexicon, read = Counter(), 0
        for rows in waiting.values():
            yield block(rows)
        if lexicon:
            yield counted()

    return run


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written index: rows with the slices of a block, and rows with counts of documents by term (``terms``, ``holding``).

    Nothing is shuffled: a task blocks its own documents. Documents without a term are not in it.
    """
    rows = text_rows(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text"))
    kind = type_of(docs, id_col)
    schema = (
        f"ids array<{kind}>, text_keys array<bigint>, sizes array<bigint>, most array<bigint>, n_terms bigint, width int, slices binary, "
        "terms array<binary>, holding array<bigint>"
    )
    return materialize(rows.mapInArrow(_indexed(_arrow_type(docs, id_col)), schema), "signatures")


def _arrow_type(df: DataFrame, column: str) -> pa.DataType:
    return to_arrow_type(df.schema[column].dataType)


class Queries:
    """The items of a pass: their terms with weights and counts, and what the scores need of the corpus."""

    def __init__(self, items: list[list[tuple[bytes, int]]], holding: dict[bytes, int], n_documents: int, n_terms: int) -> None:
        self.n_documents, self.n_terms = n_documents, n_terms
        # terms that no document holds score nothing
        self.items = [[(t, c) for t, c in item if holding.get(t)] for item in items]
        names = sorted({t for item in self.items for t, _ in item})
        self.weights = {t: math.floor(1000 * math.log((2 * n_documents + 2) / (2 * holding[t] + 1))) for t in names}
        place = {t: i for i, t in enumerate(names)}
        self.hashes = np.array([xxhash.xxh3_64_intdigest(t) for t in names], np.uint64)
        self.places = [np.array([place[t] for t, _ in item], np.int64) for item in self.items]
        self.factors = [np.array([c * self.weights[t] for t, c in item], np.int64) for item in self.items]

    def damped(self, size: int) -> int:
        """What the length of a document adds to the counts of its terms (m of the contract)."""
        return 100 - 25 + (25 * size * self.n_documents) // self.n_terms

    def score(self, item: int, counts: Counter, size: int) -> int:
        m = self.damped(size)
        return sum(c * self.weights[t] * ((SCALE * counts[t]) // (1000 * counts[t] + 12 * m)) for t, c in self.items[item] if counts[t])

    def levels(self, width: int, slices: np.ndarray, n: int) -> np.ndarray:
        """Terms times documents: how many levels the slices allow for each term, at most."""
        found = np.zeros((len(self.hashes), n), np.int8)
        alive = np.arange(len(self.hashes))
        held = np.full((len(alive), slices.shape[1]), 255, np.uint8)
        for level in range(len(LEVELS)):
            held = held & np.bitwise_and.reduce(slices[positions(entry_hashes(self.hashes[alive], level), width)], axis=1)
            some = held.any(axis=1)
            alive, held = alive[some], held[some]
            if not len(alive):
                break
            found[alive] += np.unpackbits(held, axis=1, count=n, bitorder="little").view(np.int8)
        return found

    def bounds(self, width: int, slices: bytes, sizes: np.ndarray, most: np.ndarray) -> Iterator[np.ndarray]:
        """For each item, an upper bound of the score of every document of a block."""
        n = len(sizes)
        found = self.levels(width, np.frombuffer(slices, np.uint8).reshape(width, -1), n)
        # the greatest count that a number of levels allows, and its part of the score; none for no level
        m = 75 + (25 * sizes * self.n_documents) // self.n_terms
        deepest = int(found.max(initial=0))
        part = np.zeros((deepest + 1, n), np.int64)
        for level in range(1, deepest + 1):
            upto = np.minimum(LEVELS[level] - 1, most) if level < len(LEVELS) else most
            part[level] = (SCALE * upto) // (1000 * upto + 12 * m)
        flat, columns = part.ravel(), np.arange(n)
        for places, factors in zip(self.places, self.factors):
            yield factors @ flat[found[places].astype(np.int64) * n + columns] if len(places) else np.zeros(n, np.int64)


def _bounded(queries: Queries, least: list[int] | None):
    """Pairs of an item and a document with the bound of its score.

    Without ``least``, the ``TOP`` greatest bounds of each item among the blocks of the task; with it, all documents
    whose bound is positive and not below the item's entry.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}

        def rows(item: int, ids: pa.Array, keys: pa.Array, bound: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(bound), item, np.int32)), ids, keys, pa.array(bound)], names=["item", "id", "text_key", "bound"])

        for batch in batches:
            for at in range(batch.num_rows):
                ids, keys = batch["ids"][at].values, batch["text_keys"][at].values
                sizes, most = (batch[c][at].values.to_numpy(zero_copy_only=False) for c in ("sizes", "most"))
                for item, bound in enumerate(queries.bounds(batch["width"][at].as_py(), batch["slices"][at].as_py(), sizes, most)):
                    if least is not None:
                        near = np.flatnonzero(bound >= max(1, least[item]))
                        if len(near):
                            yield rows(item, ids.take(pa.array(near)), keys.take(pa.array(near)), bound[near])
                        continue
                    near = np.flatnonzero(bound > 0)
                    if len(near) > TOP:
                        near = near[np.argpartition(-bound[near], TOP - 1)[:TOP]]
                    if not len(near):
                        continue
                    mine = (ids.take(pa.array(near)), keys.take(pa.array(near)), bound[near])
                    if item in best:
                        mine = (pa.concat_arrays([best[item][0], mine[0]]), pa.concat_arrays([best[item][1], mine[1]]), np.concatenate([best[item][2], mine[2]]))
                        order = np.argsort(-mine[2], kind="stable")[:TOP]
                        mine = (mine[0].take(pa.array(order)), mine[1].take(pa.array(order)), mine[2][order])
                    best[item] = mine
        for item, mine in best.items():
            yield rows(item, *mine)

    return run


def _scored(docs: DataFrame, pairs: DataFrame, queries: Queries, least: list[int], id_col: str, text_col: str) -> DataFrame:
    """``item``, ``id`` and the exact ``score`` above zero of the documents of ``pairs``, from their whole texts.

    Scores below the item's entry in ``least``, which ``TOP`` documents reach, are left out, and so is what the task has
    ``TOP`` better documents for.
    """
    id_type = _arrow_type(docs, id_col)
    sorts = pa.types.is_integer(id_type) or pa.types.is_string(id_type)  # in Python as in Spark

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {}

        def first(rows: list) -> list:
            return sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1]))[:TOP] if sorts else rows

        for batch in batches:
            for own, text, asked in zip(batch["id"].to_pylist(), batch["text"].to_pylist(), batch["items"].to_pylist()):
                words = terms(text)
                counts = Counter(words)
                for item in asked:
                    score = queries.score(item, counts, len(words))
                    if score > 0 and score >= least[item]:
                        rows = best.setdefault(item, [])
                        rows.append((score, own))
                        if len(rows) >= 4 * TOP:
                            best[item] = first(rows)
        for item, rows in best.items():
            rows = first(rows)
            arrays = [pa.array(np.full(len(rows), item, np.int32)), pa.array([r[1] for r in rows], id_type), pa.array([r[0] for r in rows], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["item", "id", "score"])

    asked = pairs.groupBy("id", "text_key").agg(F.collect_set("item").alias("items"))  # at most the items of a pass
    asked = asked.select(row_key(F.col("id"), F.col("text_key")).alias("key"), F.col("id").alias("asked_id"), F.col("text_key").alias("asked_key"), "items")
    rows = text_rows(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text"))
    rows = rows.withColumn("key", row_key(F.col("id"), F.col("text_key"))).join(asked, "key")
    rows = rows.filter(F.col("id").eqNullSafe(F.col("asked_id")) & (F.col("text_key") == F.col("asked_key")))
    return rows.select("id", "text", "items").mapInArrow(run, f"item int, id {type_of(docs, id_col)}, score bigint")


def _first(scored: DataFrame, *order) -> DataFrame:
    """The first ``TOP`` rows of each item with their ``rank``; Spark cuts each part down to that many before it shuffles."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= TOP)


def _terms_of(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """``number``, ``item_id``, ``terms`` and ``counts`` of the different items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [Counter(terms(t)) for t in batch["text"].to_pylist()]
            arrays = [pa.array([list(c) for c in counts], pa.list_(pa.binary())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch["number"], batch["id"], *arrays], names=["number", "item_id", "terms", "counts"])

    different = with_row_number(text_rows(items, item_col, text_col).distinct(), [F.col("id"), F.col("text")], "number")
    kind = type_of(items, item_col)
    return materialize(different.select("number", "id", "text").mapInArrow(run, f"number bigint, item_id {kind}, terms array<binary>, counts array<bigint>"), "items")


def ranked_search(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """The ``TOP`` documents with the highest scores above zero for each item.

    ``item_col``, ``rank`` (from 1), ``id_col`` and ``score``. Equal scores rank by ascending id, null ids last. Null texts
    hold no term; an item without a term, or whose terms no document holds, has no rows. Repeated documents count and rank
    each; equal rows of ``items`` are one item, and items that share an id but no text are ranked each under that id. An empty
    table on either side gives an empty result. Texts are read whole whatever their length.
    """
    spark = docs.sparkSession
    with job(spark) as scope:
        asked = _terms_of(items, item_col, item_text)
        index = build_index(docs, id_col, text_col)
        blocks = index.filter("slices IS NOT NULL")
        totals = blocks.agg(F.sum(F.size("ids")).alias("n"), F.sum("n_terms").alias("terms")).first()
        kinds = f"{item_col} {type_of(items, item_col)}, rank int, {id_col} {type_of(docs, id_col)}, score bigint"
        result = None
        n_items = asked.count()
        for start in range(0, n_items if totals["n"] else 0, ITEMS):
            block = asked.filter(F.col("number").between(start, start + ITEMS - 1))
            wanted = block.select(F.explode("terms").alias("term")).distinct()
            partial = index.filter("terms IS NOT NULL").select(F.explode(F.arrays_zip("terms", "holding")).alias("t"))
            held = partial.select(F.col("t.terms").alias("term"), F.col("t.holding").alias("n")).join(wanted, "term", "left_semi")
            holding = {bytes(r["term"]): r["n"] for r in held.groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator()}
            rows = block.orderBy("number").collect()  # at most ITEMS rows
            queries = Queries([list(zip(map(bytes, r["terms"]), r["counts"])) for r in rows], holding, totals["n"], totals["terms"])
            names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item int, {item_col} {type_of(items, item_col)}")
            pair = f"item int, id {type_of(docs, id_col)}, text_key bigint, bound bigint"
            bounded = blocks.select("ids", "text_keys", "sizes", "most", "width", "slices")
            # the documents with the greatest bounds tell a score that TOP documents reach
            likely = materialize(_first(bounded.mapInArrow(_bounded(queries, None), pair), F.desc("bound"), "id", "text_key"), "likely")
            least = [0] * len(rows)
            reached = _first(_scored(docs, likely, queries, least, id_col, text_col), F.desc("score")).groupBy("item").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
            for r in reached.filter(F.col("n") == TOP).collect():  # at most ITEMS rows
                least[r["item"]] = r["least"]
            open_ = materialize(bounded.mapInArrow(_bounded(queries, least), pair), "candidates")
            ranked = _first(_scored(docs, open_, queries, least, id_col, text_col), F.desc("score"), F.asc_nulls_last("id"))
            ranked = ranked.join(F.broadcast(names), "item").select(item_col, "rank", F.col("id").alias(id_col), "score")
            part = materialize(ranked, "ranked")
            result = part if result is None else result.unionByName(part)
        return scope.keep(materialize(spark.createDataFrame([], kinds) if result is None else result, "ranked"))


# The same ranking by joins, for tables small enough to list every term of every document.
SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS row, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), corpus AS (SELECT count(*) AS n, sum(len(terms))::BIGINT AS l FROM d WHERE len(terms) > 0),
counted AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM d) GROUP BY ALL),
weights AS (
    SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
    FROM (SELECT term, count(*) AS df FROM counted GROUP BY term), corpus
), items AS (
    SELECT item_id, text, term, count(*) AS times FROM (
        SELECT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM (SELECT DISTINCT item_id, text FROM benchmark)
    ) GROUP BY ALL
), damped AS (SELECT row, doc_id, 100 - 25 + (25 * len(terms) * n) // l AS m FROM d, corpus WHERE len(terms) > 0),
scored AS (
    SELECT item_id, text, doc_id, row, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
    FROM items JOIN weights USING (term) JOIN counted USING (term) JOIN damped USING (row)
    GROUP BY ALL
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""
