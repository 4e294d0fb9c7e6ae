"""Near-duplicates by SimHash: byte-position index, count filter, verified links, components.

A fingerprint has 8 bytes. Fingerprints that differ in at most 3 bits differ in at most 3 bytes, so
they share at least 5 bytes at equal positions. A plain index by position and byte would tally every
pair with one common byte, a fixed share of all pairs. The index here is keyed by the bytes at five
positions, once for each of the 56 choices of five: exactly the pairs that reach the count of 5 meet,
and none below it. Members of one list differ in three bytes only, so a list has at most 2^24 different
fingerprints whatever the corpus.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediatrends.llm.common import job, join_unique, materialize, row_key, text_rows, type_of, unused
from mediatrends.operators.components import connected_components

SHINGLE = 3
SEED = 42
MAX_BITS = 3
BYTES = 8
SHARED = BYTES - MAX_BITS
# A bucket holds about this many fingerprints for each choice; a task deals at most a chunk of them at a time.
BUCKET, CHUNK = 1 << 16, 1 << 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of the whole text over word shingles with repeats; zero if it has no word."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, seed)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends]
    hashes = np.array([digest(joined[s : e - 1], seed) for s, e in zip(starts, ends[shingle - 1 :])], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for part in range(0, len(hashes), 4096):
        block = hashes[part : part + 4096]
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, BYTES), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``id``, ``text_key`` (a 64-bit hash of the text) and ``fp`` (the fingerprint as a signed BIGINT) of every row."""

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in batch["text"].to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch["id"], batch["text_key"], pa.array(found.view(np.int64))], names=["id", "text_key", "fp"])

    rows = text_rows(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text"))
    return rows.mapInArrow(run, f"id {type_of(docs, id_col)}, text_key bigint, fp bigint")


def _masks() -> list[int]:
    return [sum(255 << (8 * p) for p in chosen) for chosen in combinations(range(BYTES), SHARED)]


def _mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(29))


def _chunks(batches):
    """The fingerprints of a task, in as few arrays of about CHUNK rows as hold them."""
    held, n = [], 0
    for batch in batches:
        held.append(batch["fp"].to_numpy(zero_copy_only=False).view(np.uint64))
        n += len(held[-1])
        if n >= CHUNK:
            yield np.concatenate(held)
            held, n = [], 0
    if n:
        yield np.concatenate(held)


def _postings(n_buckets: int):
    """Deal every fingerprint to the bucket of each of its 56 keys, as one array for a chunk and bucket."""
    masks = [np.uint64(m) for m in _masks()]

    def run(batches):
        for values in _chunks(batches):
            for i, mask in enumerate(masks):
                part = (_mix(values & mask) % np.uint64(n_buckets)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                named, first = np.unique(part[order], return_index=True)
                cut = np.split(values[order], first[1:])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(named * len(masks) + i),
                        pa.array(np.full(len(named), i, np.int32)),
                        pa.array([c.tobytes() for c in cut], pa.binary()),
                    ],
                    names=["bucket", "choice", "members"],
                )

    return run


def _shared_bytes(differing: np.ndarray) -> np.ndarray:
    """The tally of equal positional bytes, from the exclusive or of two fingerprints."""
    return (np.ascontiguousarray(differing).view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)


class _Forest:
    """Union-find over the rows of one list set; roots are kept flat as an array."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join the trees of each pair, by repeated hooking to the smaller root."""
        while True:
            ra, rb = self.root[a], self.root[b]
            open_ = ra != rb
            if not open_.any():
                return
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                jumped = self.root[self.root]
                if np.array_equal(jumped, self.root):
                    break
                self.root = jumped


def _flips(free: list[int]) -> np.ndarray:
    """All changes of 1 to MAX_BITS bits within the free positions."""
    return np.array([sum(1 << b for b in bits) for n in range(1, MAX_BITS + 1) for bits in combinations(free, n)], dtype=np.uint64)


def _links(members: np.ndarray, mask: int) -> np.ndarray:
    """Star edges that connect the members linked within their lists, as rows (member, least member).

    Lists are compared row against the row ``step`` further on, for all lists at once. A list with more
    members than there are changes of three bits in its free bytes looks up those changes instead, so the
    work for a member is bounded whatever the size of its list.
    """
    members = np.unique(members)
    key = members & np.uint64(mask)
    order = np.argsort(key, kind="stable")
    members, key = members[order], key[order]
    size = np.diff(np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))) if len(key) else np.array([], int)
    own = np.repeat(size, size)
    members, key, own = members[own > 1], key[own > 1], own[own > 1]
    forest = _Forest(len(members))
    changes = _flips([b for b in range(64) if not mask >> b & 1])
    near = np.flatnonzero(own <= 2 * len(changes))
    for step in range(1, int(own[near].max()) if len(near) else 0):
        near = near[near + step < len(members)]
        near = near[key[near + step] == key[near]]
        if not len(near):
            break
        open_ = near[forest.root[near] != forest.root[near + step]]
        differing = members[open_] ^ members[open_ + step]
        kept = _shared_bytes(differing) >= SHARED  # count filter
        kept[kept] = np.bitwise_count(differing[kept]) <= MAX_BITS  # verification
        forest.link(open_[kept], open_[kept] + step)
    crowded = np.flatnonzero(own > 2 * len(changes))
    if len(crowded):
        ordered = np.sort(members[crowded])
        at = crowded[np.argsort(members[crowded])]
        for change in changes:
            wanted = ordered ^ change
            place = np.minimum(np.searchsorted(ordered, wanted), len(ordered) - 1)
            hit = ordered[place] == wanted
            forest.link(at[hit], at[place[hit]])
    linked = np.flatnonzero(forest.root != np.arange(len(members)))
    return np.stack([members[linked], members[forest.root[linked]]], axis=1).view(np.int64)


def link_edges(fps: DataFrame) -> DataFrame:
    """Edges ``src``, ``dst`` that connect the different fingerprints ``fp`` linked at 3 or fewer bits.

    They are a spanning set of the links, not all of them: their components are those of all links.
    ``fps`` is a table, read twice. Its rows alone set the number of buckets, whatever the shuffle partitions.
    """
    n_buckets = max(1, -(-fps.count() // BUCKET))
    masks = _masks()

    def run(table: pa.Table) -> pa.Table:
        members = np.frombuffer(b"".join(table["members"].to_pylist()), dtype=np.uint64)
        edges = _links(members, masks[table["choice"][0].as_py()])
        return pa.table({"src": pa.array(edges[:, 0]), "dst": pa.array(edges[:, 1])})

    posted = fps.select("fp").mapInArrow(_postings(n_buckets), "bucket bigint, choice int, members binary")
    return posted.groupBy("bucket").applyInArrow(run, "src bigint, dst bigint")


def _named(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the rows of ``fingerprints``: ``fp``, ``n``, ``root`` and ``first`` by fingerprint, and ``first`` by ``root``.

    ``first`` is the row of a component with the smallest id; rows without an id come last.
    """
    first = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_key")
    by_fp = materialize(rows.groupBy("fp").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n")), "fps")
    edges = materialize(link_edges(by_fp), "links")
    roots = connected_components(edges).withColumnRenamed("id", "fp")
    rooted = by_fp.join(roots, "fp", "left").withColumn("root", F.coalesce("component", "fp")).drop("component")
    rooted = materialize(rooted, "roots")
    by_root = materialize(rooted.groupBy("root").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("n_fps")), "named")
    return rooted.drop("first"), by_root


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``id_col``, ``fingerprint`` (16 hex digits) and ``component_id`` of every row of ``docs``.

    Rows whose fingerprints differ in at most 3 bits are linked; a component is named by its smallest
    id, which is null only if no row of it has an id. Null and empty texts have fingerprint zero and link
    like others. Repeated rows are returned as often as they occur. An empty table gives an empty one.
    """
    with job(docs.sparkSession) as scope:
        rows = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
        rooted, by_root = _named(rows)
        named = join_unique(rooted, by_root, "root", F.col("n_fps")).select("fp", "n", F.col("first.id").alias("component_id"))
        joined = join_unique(rows, materialize(named, "named"), "fp", F.col("n"))
        hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
        return scope.keep(materialize(joined.select(F.col("id").alias(id_col), hexed, "component_id"), "components"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near-duplicates of ``docs``: the one with the smallest id. Columns are unchanged.

    Rows without an id come last; rows equal in id and text count as one. The groups are computed, the rows not yet.
    """
    with job(docs.sparkSession) as scope:
        named = scope.keep(_named(materialize(fingerprints(docs, id_col, text_col), "fingerprints"))[1])
    return keep_rows(docs, named, id_col, text_col)


def keep_rows(docs: DataFrame, named: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that are ``first`` in ``named``, each once."""
    own_key, own_text, first_key, first_id, first_text = unused(docs, "row_key", "text_key", "first_key", "first_id", "first_text")
    kept = named.select(row_key(F.col("first.id"), F.col("first.text_key")).alias(first_key), F.col("first.id").alias(first_id), F.col("first.text_key").alias(first_text))
    rows = docs.withColumn(own_text, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    rows = rows.withColumn(own_key, row_key(F.col(id_col), F.col(own_text)))
    same = (F.col(own_key) == F.col(first_key)) & F.col(id_col).eqNullSafe(F.col(first_id)) & (F.col(own_text) == F.col(first_text))
    # rows stay where the join has put them
    return rows.join(kept, same, "left_semi").dropDuplicates([own_key, id_col, own_text]).select(*docs.columns)
