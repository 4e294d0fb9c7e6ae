"""Near-duplicates by similarity: sets of 5-word shingles whose Jaccard similarity is at least 0.8.

A signature has 64 positional bytes, the least of 64 hashes over the shingles of a text. Texts that share the 4 bytes
of any of 16 choices meet in a list: at similarity 0.8 all but about one pair in 4,800 do. So do texts whose SimHash
fingerprints over the same shingles are connected at 3 or fewer differing bits. The pairs of a list are then compared by
their whole shingle sets, so no pair below 0.8 is linked.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediatrends.llm.common import job, join_unique, materialize, row_key, text_rows, type_of
from mediatrends.llm.simhash import _LOWER, SEED, fingerprint, keep_rows, link_edges
from mediatrends.operators.components import connected_components

SHINGLE = 5
PERCENT = 80  # least Jaccard similarity
CHOICE, CHOICES = 4, 16
# Choices whose lists are compared first; most similar texts share one of them.
FIRST_CHOICES = 4
# A list with more members is cut into parts, each of which names this many sets to be compared with all others.
PART = 512
PIVOTS = 4

_draw = np.random.default_rng(SEED)
_FACTORS = _draw.integers(1 << 32, size=CHOICE * CHOICES, dtype=np.uint32) | np.uint32(1)
_ADDED = _draw.integers(1 << 32, size=CHOICE * CHOICES, dtype=np.uint32)


def shingles(text: str) -> np.ndarray:
    """The different shingles of a text as sorted 64-bit hashes; a shorter text is one shingle."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends]
    return np.unique(np.array([digest(joined[s : e - 1], SEED) for s, e in zip(starts, ends[SHINGLE - 1 :])], np.uint64))


def signature(hashes: np.ndarray) -> np.ndarray:
    """64 bytes, each from the least of one hash over all shingles."""
    least = np.full(len(_FACTORS), 0xFFFFFFFF, np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for part in range(0, len(short), 4096):
        mixed = short[None, part : part + 4096] ^ _ADDED[:, None]
        mixed *= _FACTORS[:, None]
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x2C1B3C6D)
        least = np.minimum(least, mixed.min(axis=1))
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def _signed(batches):
    for batch in batches:
        texts = batch["text"].to_pylist()
        sets = [shingles(t) for t in texts]
        names = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
        signs = pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary())
        bits = pa.array(np.array([fingerprint(t, SHINGLE) for t in texts], np.uint64).view(np.int64))
        columns = [batch["id"], batch["text_key"], pa.array(names), signs, bits]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "text_key", "fp", "sign", "bits"])


def _posted(batches):
    """The lists of each signature: the number of the choice and its four bytes."""
    for batch in batches:
        signs = np.frombuffer(b"".join(batch["sign"].to_pylist()), np.uint8).reshape(-1, CHOICES * CHOICE)
        keys = np.ascontiguousarray(signs).view(np.uint32).astype(np.int64) | np.arange(CHOICES, dtype=np.int64) << 32
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys.ravel()), batch["fp"].take(pa.array(np.repeat(np.arange(len(keys)), CHOICES)))], names=["list", "fp"]
        )


def _fingerprint_lists(signed: DataFrame) -> DataFrame:
    """The list of each signature's fingerprint: one behind the choices for each component of near fingerprints."""
    given = signed.select("fp", "bits")
    different = materialize(given.select(F.col("bits").alias("fp")).distinct(), "bits")
    edges = materialize(link_edges(different), "near_bits")
    near = connected_components(edges).withColumnRenamed("id", "bits")
    # components that share a list are compared for nothing, and lose nothing
    name = F.pmod(F.xxhash64(F.coalesce("component", "bits")), F.lit(1 << 32)) + F.lit(CHOICES << 32)
    return given.join(near, "bits", "left").select(name.alias("list"), "fp")


def _sets(batches):
    for batch in batches:
        found = [shingles(t).tobytes() for t in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["fp"], pa.array(found, pa.binary())], names=["fp", "shingles"])


class _Sets:
    """Shingle sets of a tile, as codes with the start of each set."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.size = np.array([len(s) for s in sets])
        _, self.code, self.often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        self.starts = np.concatenate([[0], np.cumsum(self.size)[:-1]])

    def commonness(self) -> np.ndarray:
        """How many sets hold a shingle of each set, on average."""
        return np.add.reduceat(self.often[self.code], self.starts) / self.size

    def near(self, pivot: int) -> np.ndarray:
        """The sets that are similar enough to the set at ``pivot``."""
        own = np.zeros(len(self.often), bool)
        own[self.code[self.starts[pivot] : self.starts[pivot] + self.size[pivot]]] = True
        common = np.add.reduceat(own[self.code].astype(np.int64), self.starts)
        return 100 * common >= PERCENT * (self.size + self.size[pivot] - common)


def link(sets: list[np.ndarray], chosen: list[int] | None = None, root: np.ndarray | None = None) -> tuple[list[tuple[int, int]], list[int]]:
    """Edges that connect all similar pairs of ``sets``, or those with a ``chosen`` one, and the sets most common first.

    A set is compared with all that are not linked to it yet; ``root`` tells what is linked from the start. Sets whose
    shingles are the most common come first: the text that many others are copies of links them at once.
    """
    if len(sets) < 2:
        return [], list(range(len(sets)))
    held, edges = _Sets(sets), []
    root = np.arange(len(sets)) if root is None else root.copy()
    order = np.argsort(-held.commonness(), kind="stable").tolist()
    wanted = None if chosen is None else set(chosen)
    for pivot in order:
        if (root == root[pivot]).all():
            break
        if wanted is not None and pivot not in wanted:
            continue
        for other in np.flatnonzero(held.near(pivot) & (root != root[pivot])).tolist():
            if root[other] != root[pivot]:
                edges.append((pivot, other))
                root[root == root[other]] = root[pivot]
    return edges, order


def _tiles(batches, keys: list[str], columns: list[str]):
    """The rows of each tile as a list of tuples; rows of a tile come together, and a tile is held at a time."""
    last, rows = None, []
    for batch in batches:
        named = zip(*(batch[c].to_pylist() for c in keys))
        for key, row in zip(named, zip(*(batch[c].to_pylist() for c in columns))):
            if key != last:
                if rows:
                    yield last, rows
                last, rows = key, []
            rows.append(row)
    if rows:
        yield last, rows


def _edge_batch(edges: list[tuple[int, int]], pivots: list[tuple[int, int]] = ()) -> pa.RecordBatch:
    """Edges, and pivots of lists as rows without an end."""
    src = [e[0] for e in edges] + [fp for _, fp in pivots]
    dst = [e[1] for e in edges] + [None] * len(pivots)
    lists = [None] * len(edges) + [name for name, _ in pivots]
    columns = {"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64()), "list": pa.array(lists, pa.int64())}
    return pa.RecordBatch.from_pydict(columns)


def _linked_inside(batches):
    """Edges between the roots within each part of a list, and its most common sets if the list has other parts."""
    for (name, _), rows in _tiles(batches, ["list", "part"], ["fp", "shingles", "parts", "root"]):
        _, root = np.unique(np.array([r[3] for r in rows], np.int64), return_inverse=True)
        edges, order = link([np.frombuffer(r[1], np.uint64) for r in rows], None, root)
        pivots = [(name, rows[i][0]) for i in order[:PIVOTS]] if rows[0][2] > 1 else []
        yield _edge_batch([(rows[a][3], rows[b][3]) for a, b in edges], pivots)


def _linked_across(batches):
    """Edges between the roots of the chosen members of a list and those of one of its parts."""
    for _, rows in _tiles(batches, ["list", "a", "part"], ["fp", "shingles", "root", "is_chosen"]):
        chosen = [i for i, r in enumerate(rows) if r[3]]
        if len(chosen) in (0, len(rows)):
            continue  # one side has no row
        _, root = np.unique(np.array([r[2] for r in rows], np.int64), return_inverse=True)
        edges, _ = link([np.frombuffer(r[1], np.uint64) for r in rows], chosen, root)
        yield _edge_batch([(rows[a][2], rows[b][2]) for a, b in edges])


_EDGES = "src bigint, dst bigint, list bigint"


def _part(parts: Column) -> Column:
    return F.pmod(F.xxhash64("fp"), parts).cast("int")


def _across(chosen: DataFrame, members: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges between the ``chosen`` members of some lists and all ``members`` of these lists (``list``, ``parts``, ``fp``, ``root``).

    Both are cut into parts, and a tile is a part of each; a member's shingles are sent once for each part of the chosen.
    """
    n_chosen = chosen.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("chosen_parts"))
    n_chosen = F.broadcast(materialize(n_chosen, "chosen"))  # a row for each list that is longer than a part
    all_ = members.join(n_chosen, "list").withColumn("part", _part(F.col("parts"))).withColumn("a", F.explode(F.sequence(F.lit(0), F.col("chosen_parts") - 1)))
    picked = chosen.join(n_chosen, "list").withColumn("a", _part(F.col("chosen_parts")))
    picked = picked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    columns = ["list", "a", "part", "fp", "root"]
    dealt = all_.select(*columns, F.lit(False).alias("is_chosen")).unionByName(picked.select(*columns, F.lit(True).alias("is_chosen")))
    dealt = dealt.join(sets, "fp").repartition("list", "a", "part").sortWithinPartitions("list", "a", "part")
    return dealt.mapInArrow(_linked_across, _EDGES)


class _Linker:
    """The members of all lists with the root of each, and what new edges between roots make of them."""

    def __init__(self, members: DataFrame) -> None:
        self.rooted = members.withColumn("root", F.col("fp"))

    def add(self, *edges: DataFrame) -> None:
        """Join the components that edges between their roots connect."""
        every = edges[0]
        for more in edges[1:]:
            every = every.unionByName(more)
        found = connected_components(every.filter("dst IS NOT NULL").select("src", "dst"))
        found = found.withColumnRenamed("id", "root").withColumnRenamed("component", "joined")
        joined = self.rooted.join(found, "root", "left").withColumn("root", F.coalesce("joined", "root")).drop("joined")
        self.rooted = materialize(joined, "rooted")

    def open_lists(self, condition: str) -> DataFrame:
        """Lists with members in several components: ``list`` and the ``most`` frequent root."""
        each = self.rooted.filter(condition).groupBy("list", "root").agg(F.count(F.lit(1)).alias("n"))
        most = F.max_by("root", F.struct("n", "root")).alias("most")
        return materialize(each.groupBy("list").agg(most, F.count(F.lit(1)).alias("n_roots")).filter("n_roots > 1").select("list", "most"), "open")


def similar_roots(by_fp: DataFrame, sets_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``fp`` and ``root`` of the signatures (``fp``, ``sign``, ``bits``) that share a list with another one.

    The lists of the first choices link most of what is similar; of the others only lists whose members are not linked
    yet are compared. A list is first compared part by part. If it has several, the most common sets of every part, and
    then the members outside its largest component, are compared with all others: of two members that are not linked one
    is always among these. So a cluster of copies costs its members times its parts' few pivots, not all pairs of parts.
    """
    signed = by_fp.filter("sign IS NOT NULL")
    posted = signed.select("fp", "sign").mapInArrow(_posted, "list bigint, fp bigint").unionByName(_fingerprint_lists(signed))
    posted = materialize(posted, "posted")
    lists = materialize(posted.groupBy("list").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "lists")
    parts = F.ceil(F.col("n") / PART).cast("int").alias("parts")
    members = materialize(join_unique(posted, lists, "list", F.col("n")).select("list", "fp", parts), "members")
    sets = materialize(sets_of(members.select("fp").distinct()), "shingles")
    has_long = not members.filter("parts > 1").isEmpty()
    linker = _Linker(members)
    for first, last in ((0, FIRST_CHOICES), (FIRST_CHOICES, CHOICES + 1)):  # fingerprints last
        mine = f"list >> 32 >= {first} AND list >> 32 < {last}"
        open_ = linker.open_lists(mine)
        held = materialize(linker.rooted.filter(mine).join(open_.select("list"), "list"), "held")  # read by each step below
        inside = held.withColumn("part", _part(F.col("parts"))).select("list", "part", "parts", "fp", "root")
        inside = inside.join(sets, "fp").repartition("list", "part").sortWithinPartitions("list", "part")
        found = materialize(inside.mapInArrow(_linked_inside, _EDGES), "links")
        if not has_long:
            linker.add(found)
            continue
        long_ = held.filter("parts > 1")
        pivots = materialize(long_.join(found.filter("dst IS NULL").select("list", F.col("src").alias("fp")), ["list", "fp"]), "pivots")
        linker.add(found, materialize(_across(pivots, long_, sets), "links"))
        open_ = linker.open_lists(f"parts > 1 AND {mine}")
        if not open_.isEmpty():
            held = materialize(linker.rooted.join(open_, "list"), "held")
            apart = held.filter(F.col("root") != F.col("most"))
            linker.add(materialize(_across(apart, held, sets), "links"))
    return linker.rooted.select("fp", "root").distinct()


def keep_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of similar rows of ``docs``: the one with the smallest id. Columns are unchanged.

    Groups are the components of all pairs that are similar enough. Texts without a word are equal. Rows without an id
    come last; rows equal in id and text count as one. The groups are computed, the rows not yet.
    """
    with job(docs.sparkSession) as scope:
        rows = text_rows(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text"))
        kind = type_of(docs, id_col)
        signed = rows.mapInArrow(_signed, f"id {kind}, text_key bigint, fp bigint, sign binary, bits bigint")
        first = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_key")
        by_fp = materialize(signed.groupBy("fp").agg(F.min(first).alias("first"), F.min("sign").alias("sign"), F.min("bits").alias("bits")), "signed")

        def sets_of(wanted: DataFrame) -> DataFrame:
            # one row tells the shingles of all rows with the same ones; it is found by id and text, not by text alone,
            # so that the copies of a text do not meet
            asked = by_fp.join(wanted, "fp", "left_semi").select("fp", row_key(F.col("first.id"), F.col("first.text_key")).alias("key"), F.col("first.text_key").alias("asked"))
            texts = rows.withColumn("key", row_key(F.col("id"), F.col("text_key"))).join(asked, "key").filter(F.col("text_key") == F.col("asked"))
            return texts.select("fp", "text").mapInArrow(_sets, "fp bigint, shingles binary").dropDuplicates(["fp"])

        roots = similar_roots(by_fp, sets_of)
        rooted = by_fp.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        named = scope.keep(materialize(rooted.groupBy("root").agg(F.min("first").alias("first")), "named"))
    return keep_rows(docs, named, id_col, text_col)
