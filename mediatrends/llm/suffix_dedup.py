"""Removal of byte strings that occur elsewhere, by blockwise suffix sorting with a difference cover.

A string is judged by the windows of ``MIN_BYTES`` bytes in it; window i repeats if an equal one starts at
another place. Two suffixes that share a window also share a place of the cover sample: for any two starts
there is one offset below the period at which both stand on sampled places. So the work is done in the order
of blockwise suffix sorting, a bucket of suffixes at a time:

1. The sampled suffixes are sorted by their next ``MIN_BYTES - period + 1`` bytes. Those that nobody shares are done.
2. Sampled suffixes that share these bytes are sorted by their whole surroundings, from one period before to
   ``MIN_BYTES`` after. Equal surroundings get one rank: all windows that begin in the period before them
   repeat, however long the match goes on. This settles long ties, the inside of copies, without
   touching their other suffixes.
3. Other suffixes matter only in the period before a sampled one whose bytes are shared but whose surroundings
   differ, at the borders of matches. They are sorted by window, one bucket at a time, and only for the first
   suffix of each rank, since the others are settled.

Suffixes are ordered by 64-bit digests of the bytes named, not by the bytes: equal strings meet all the same,
and a bucket holds numbers only. Every chunk of documents sends a digest once, marked if it has it several
times, so a passage that a third of all documents share reaches a bucket once for each chunk. A bucket answers
in the order it was asked, so places never travel.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediatrends.llm.common import job, materialize, settings, text_rows, type_of

MIN_BYTES = 200
CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 24 << 20  # bytes of text for each suffix bucket, at least

# A row is a chunk of megabytes. Parquet would first look at the size of a page after 100 rows and read 4096 at a time, and
# lists of answers would be held for 1000 chunks before they are sorted; here all three are bounded in bytes.
_WRITING = {
    "spark__sql__parquet__compression__codec": "zstd",
    "parquet__block__size": str(16 << 20),
    **{f"parquet__{part}__size__row__check__{end}": "1" for part in ("block", "page") for end in ("min", "max")},
}
_READING = {
    "spark__sql__execution__arrow__maxRecordsPerBatch": "2",  # of chunks
    "spark__sql__parquet__columnarReaderBatchSize": "4",
    "spark__sql__objectHashAggregate__sortBased__fallbackThreshold": "16",
}

# Perfect difference sets. Every difference modulo the period occurs once among the residues.
COVERS = {
    7: (0, 1, 3),
    13: (0, 1, 3, 9),
    21: (0, 1, 4, 14, 16),
    31: (0, 1, 3, 8, 12, 18),
    57: (0, 1, 3, 13, 32, 36, 43, 52),
    73: (0, 1, 3, 7, 15, 31, 36, 54, 63),
    91: (0, 1, 3, 9, 27, 49, 56, 61, 77, 81),
    133: (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109),
}

_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(2024).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def cover_period(min_bytes: int) -> int:
    """The longest period that leaves at least a third of a window to the sampled suffix."""
    fitting = [p for p in COVERS if 3 * p <= 2 * min_bytes]
    if not fitting:
        raise ValueError("windows must have at least 11 bytes")
    return max(fitting)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Chunk:
    """Documents one after another, with digests of any stretch and the places of the cover sample."""

    def __init__(self, body: bytes, lengths: np.ndarray, min_bytes: int) -> None:
        self.body, self.min_bytes, self.period = np.frombuffer(body, np.uint8), min_bytes, cover_period(min_bytes)
        up, self.down = _power(len(body) + 1)
        self.sums = np.zeros(len(body) + 1, np.uint64)
        np.cumsum(_TABLE[self.body] * up[: len(body)], out=self.sums[1:])
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        self._sample()

    def digest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (self.sums[high] - self.sums[low]) * self.down[low]

    def _sample(self) -> None:
        witness = self.min_bytes - self.period + 1
        long_ = np.flatnonzero(self.ends - self.starts >= self.min_bytes)
        periods = -(-(self.ends - self.starts)[long_] // self.period)
        doc = np.repeat(long_, periods)
        turn = np.arange(len(doc)) - np.repeat(np.cumsum(periods) - periods, periods)
        place = ((self.starts[doc] + self.period * turn)[:, None] + np.array(COVERS[self.period])).ravel()
        doc = np.repeat(doc, len(COVERS[self.period]))
        inside = place + witness <= self.ends[doc]
        self.place, doc = place[inside], doc[inside]
        self.low = np.maximum(self.place - (self.period - 1), self.starts[doc])  # first window that the place can settle
        self.last = np.minimum(self.place, self.ends[doc] - self.min_bytes)
        high = np.minimum(self.place + self.min_bytes, self.ends[doc])
        self.key = _mix(self.digest(self.place, self.place + witness))
        # what is cut off by the document's ends is part of the surroundings
        cut = ((self.place - self.low) << 32) + (high - self.place)
        self.around = _mix(self.digest(self.low, high) + _mix(cut.astype(np.uint64)))

    def windows(self, chosen: np.ndarray) -> np.ndarray:
        """Starts of all windows in the period before the chosen places."""
        marks = np.zeros(len(self.body) + 1, np.int32)
        good = chosen[self.last[chosen] >= self.low[chosen]]
        np.add.at(marks, self.low[good], 1)
        np.add.at(marks, self.last[good] + 1, -1)
        return np.flatnonzero(np.cumsum(marks[:-1]) > 0)


class Asked:
    """Distinct digests in order, each with marks for its bucket; remembers who asked."""

    def __init__(self, digests: np.ndarray) -> None:
        order = np.argsort(digests, kind="stable")
        ordered = digests[order]
        fresh = np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)]
        self.digests = ordered[fresh]
        self.first = order[fresh]
        self.rank = np.empty(len(digests), np.int64)
        self.rank[order] = np.cumsum(fresh) - 1
        self.several = np.bincount(self.rank, minlength=len(self.digests)) > 1

    def rows(self, chunk: int, values: np.ndarray, n_buckets: int) -> pa.RecordBatch:
        bucket = (self.digests >> np.uint64(40)) * np.uint64(n_buckets) >> np.uint64(24)
        cuts = np.searchsorted(bucket, np.arange(n_buckets + 1, dtype=np.uint64))
        full = np.flatnonzero(cuts[1:] > cuts[:-1])
        parts = [(cuts[b], cuts[b + 1]) for b in full]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(full.astype(np.int32)),
                pa.array(np.full(len(full), chunk, np.int64)),
                pa.array([self.digests[a:b].tobytes() for a, b in parts], pa.binary()),
                pa.array([values[a:b].tobytes() for a, b in parts], pa.binary()),
            ],
            names=["bucket", "chunk", "digests", "values"],
        )


def _keys(chunk: Chunk) -> tuple[Asked, np.ndarray]:
    """Step 1 asks for each key: its surroundings, with bit 0 set if several, bit 1 if they differ."""
    asked = Asked(chunk.key)
    around = chunk.around & ~np.uint64(3)
    first = around[asked.first]
    differ = np.bincount(asked.rank, weights=around != first[asked.rank], minlength=len(first)) > 0
    return asked, first | asked.several.astype(np.uint64) | differ.astype(np.uint64) << np.uint64(1)


def _answer_keys(digests: np.ndarray, values: np.ndarray) -> np.ndarray:
    """1 if the key occurs elsewhere in the same surroundings only, 2 if in others too."""
    asked = Asked(digests)
    around = values >> np.uint64(2)
    differ = (around != around[asked.first][asked.rank]) | (values & np.uint64(2) > 0)
    differ = np.bincount(asked.rank, weights=differ, minlength=len(asked.digests)) > 0
    several = asked.several | (np.bincount(asked.rank, weights=values & np.uint64(1), minlength=len(asked.digests)) > 0)
    return np.where(differ, 2, several)[asked.rank].astype(np.uint8)


def _answer_ranks(digests: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Bit 0 if the surroundings occur elsewhere, bit 1 for the first that asks."""
    asked = Asked(digests)
    several = asked.several | (np.bincount(asked.rank, weights=values, minlength=len(asked.digests)) > 0)
    found = several[asked.rank].astype(np.uint8)
    found[asked.first] |= 2
    return found


def _answer_windows(digests: np.ndarray, values: np.ndarray) -> np.ndarray:
    return _answer_ranks(digests, values) & 1


class Steps:
    """What each step asks for a chunk, given the answers so far."""

    def __init__(self, chunk: Chunk, answers: dict[int, np.ndarray]) -> None:
        self.chunk = chunk
        self.answers = answers
        self.keys, self.key_values = _keys(chunk)
        if 1 in answers:
            answer = answers[1][self.keys.rank]
            self.settled = np.flatnonzero(answer == 1)
            self.mixed = np.flatnonzero(answer == 2)
            self.ranks = Asked(chunk.around[self.mixed])
        if 2 in answers:
            answer = answers[2]
            self.settled = np.concatenate([self.settled, self.mixed[(answer & 1)[self.ranks.rank] > 0]])
            leaders = self.mixed[self.ranks.first[answer & 2 > 0]]
            self.open = chunk.windows(leaders)
            self.window = Asked(_mix(chunk.digest(self.open, self.open + chunk.min_bytes)))

    def ask(self) -> tuple[Asked, np.ndarray]:
        if 1 not in self.answers:
            return self.keys, self.key_values
        asked = self.ranks if 2 not in self.answers else self.window
        return asked, asked.several.astype(np.uint8)

    def covered(self) -> np.ndarray:
        """Whether each byte lies in a window that occurs elsewhere."""
        repeated = (self.answers[3] > 0) | self.window.several
        starts = np.concatenate([self.chunk.windows(self.settled), self.open[repeated[self.window.rank]]])
        marks = np.zeros(len(self.chunk.body) + 1, np.int32)
        starts = np.unique(starts)
        marks[starts] += 1
        marks[starts + self.chunk.min_bytes] -= 1
        return np.cumsum(marks[:-1]) > 0


_ASK = "bucket int, chunk bigint, digests binary, values binary"
_ANSWER = "chunk bigint, step int, bucket int, answer binary"
_ANSWERS = {1: (_answer_keys, np.uint64), 2: (_answer_ranks, np.uint8), 3: (_answer_windows, np.uint8)}


def _chunks(rows: DataFrame, id_type: str, chunk_bytes: int) -> DataFrame:
    """Pack the documents of each task into chunks; a longer document is a chunk of its own."""

    def run(batches):
        part, n, size, ids, texts = TaskContext.get().partitionId(), 0, 0, [], []

        def packed():
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part << 32 | n], pa.int64()),
                    pa.array([size], pa.int64()),
                    pa.ListArray.from_arrays([0, len(texts)], pa.concat_arrays(ids)),
                    pa.array([list(map(len, texts))], pa.list_(pa.int64())),
                    pa.array([b"".join(texts)], pa.binary()),
                ],
                names=["chunk", "size", "ids", "lengths", "body"],
            )

        for batch in batches:
            begin = 0
            for i, text in enumerate(batch["text"].cast(pa.binary()).to_pylist()):
                if texts and size + len(text) > chunk_bytes:
                    ids.append(batch["id"].slice(begin, i - begin))
                    yield packed()
                    begin, n, size, ids, texts = i, n + 1, 0, [], []
                texts.append(text)
                size += len(text)
            ids.append(batch["id"].slice(begin))
        if texts:
            yield packed()

    return rows.mapInArrow(run, f"chunk bigint, size bigint, ids array<{id_type}>, lengths array<bigint>, body binary")


def _each_chunk(batch: pa.RecordBatch, min_bytes: int):
    """The chunks of a batch with the answers they have."""
    for row in range(batch.num_rows):
        lengths = batch["lengths"][row].values.to_numpy(zero_copy_only=False)
        parts: dict[int, list] = {}
        if "answers" in batch.schema.names and batch["answers"][row].is_valid:
            for x in batch["answers"][row].as_py():
                parts.setdefault(x["step"], []).append((x["bucket"], x["answer"]))
        answers = {s: np.frombuffer(b"".join(a for _, a in sorted(p)), np.uint8) for s, p in parts.items()}
        yield row, Chunk(batch["body"][row].as_py(), lengths, min_bytes), answers


def _asked(chunks: DataFrame, step: int, min_bytes: int, n_buckets: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for row, chunk, answers in _each_chunk(batch, min_bytes):
                for earlier in range(1, step):
                    answers.setdefault(earlier, np.zeros(0, np.uint8))  # it asked nothing
                asked, values = Steps(chunk, answers).ask()
                yield asked.rows(batch["chunk"][row].as_py(), values, n_buckets)

    return chunks.mapInArrow(run, _ASK)


def _answered(asked: DataFrame, step: int) -> DataFrame:
    answer, kind = _ANSWERS[step]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        digests = [np.frombuffer(x, np.uint64) for x in table["digests"].to_pylist()]
        values = np.frombuffer(b"".join(table["values"].to_pylist()), kind)
        found = answer(np.concatenate(digests), values)
        cuts = np.cumsum([0, *map(len, digests)])
        return pa.table(
            {
                "chunk": table["chunk"],
                "step": pa.array(np.full(len(digests), step, np.int32)),
                "bucket": table["bucket"],
                "answer": pa.array([found[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
            }
        )

    return asked.groupBy("bucket").applyInArrow(run, _ANSWER)


def _with_answers(chunks: DataFrame, answers: list[DataFrame]) -> DataFrame:
    together = answers[0]
    for more in answers[1:]:
        together = together.unionByName(more)
    by_chunk = together.groupBy("chunk").agg(F.collect_list(F.struct("step", "bucket", "answer")).alias("answers"))
    # answers are far smaller in their files than in a list: never broadcast them
    return chunks.join(by_chunk.hint("merge"), "chunk", "left")


def _results(chunks: DataFrame, id_type: str, min_bytes: int, texts: bool) -> DataFrame:
    def run(batches):
        for batch in batches:
            for row, chunk, answers in _each_chunk(batch, min_bytes):
                for step in _ANSWERS:
                    answers.setdefault(step, np.zeros(0, np.uint8))
                covered = Steps(chunk, answers).covered()
                lead = covered.copy()  # bytes that begin a removed run
                lead[1:] &= ~covered[:-1]
                inner = chunk.starts[chunk.ends > chunk.starts]
                lead[inner] = covered[inner]
                upto, spans = np.concatenate([[0], np.cumsum(covered)]), np.concatenate([[0], np.cumsum(lead)])
                removed = upto[chunk.ends] - upto[chunk.starts]
                kept = [
                    chunk.body[s:e][~covered[s:e]].tobytes() if r else chunk.body[s:e].tobytes()
                    for s, e, r in zip(chunk.starts.tolist(), chunk.ends.tolist(), removed.tolist())
                ]
                columns = [
                    batch["ids"][row].values,
                    pa.array(chunk.ends - chunk.starts),
                    pa.array(removed, pa.int64()),
                    pa.array(spans[chunk.ends] - spans[chunk.starts], pa.int64()),
                    pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                ]
                names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if texts:
                    columns.append(pa.array([k.decode(errors="ignore") for k in kept], pa.string()))
                    names.append("kept_text")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"id {id_type}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept_text string" * texts
    return chunks.mapInArrow(run, schema)


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = MIN_BYTES, chunk_bytes: int = CHUNK_BYTES, texts: bool = False
) -> DataFrame:
    """Remove from every text each byte that lies in a string of ``min_bytes`` bytes that also starts elsewhere.

    ``id_col``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs) and ``kept_sha256`` (digest of the bytes
    that remain); with ``texts`` also ``kept_text``, where characters that were cut apart are dropped. Texts are UTF-8,
    null is empty, matches never cross documents. All places of a repeated string go, the first included. Rows that
    are equal repeat each other. Ids may be null or repeated: they are only carried. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    id_type = type_of(docs, id_col)
    with job(spark) as scope:
        chunks_of = _chunks(text_rows(docs, id_col, text_col), id_type, chunk_bytes)
        with settings(spark, **_WRITING):
            chunks = materialize(chunks_of, "chunks")
        with settings(spark, **_READING):
            total = chunks.agg(F.sum("size")).first()[0] or 0
            n_buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
            answers: list[DataFrame] = []
            for step in _ANSWERS:
                known = _with_answers(chunks, answers) if answers else chunks
                answers.append(materialize(_answered(_asked(known, step, min_bytes, n_buckets), step), f"answers_{step}"))
            found = _results(_with_answers(chunks, answers), id_type, min_bytes, texts)
            return scope.keep(materialize(found.withColumnRenamed("id", id_col), "repeats_removed"))
