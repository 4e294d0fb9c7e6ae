"""Mixing sources to target weights by weighted fair queueing.

Every source sends its documents in shuffled order, and begins again at its end. A document's virtual
finish time is the number of its source's words sent up to and with it, divided by the source's target.
The mix is the documents in the order of these times, cut at the total budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediatrends.llm.common import WORD, job, join_unique, materialize, row_key, unused
from mediatrends.session import with_row_number, with_row_order

CYCLE = 3  # weights 1, 2, 3, 1, 2, 3, ... by the order of the sources
MOST_COPIES = 3
SLICE_DIGITS = 3  # hexadecimal digits of the shuffle key that name a slice of a source


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``id``, ``text_key``, ``source``, ``key`` (never null), ``size`` and the shuffle key ``turn``."""
    source = F.col(source_col).cast("string")
    return docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"),
        source.alias("source"),
        F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("key"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("turn"),
    )


def targets(sized: DataFrame) -> DataFrame:
    """One row per source: ``key``, ``n``, ``place``, ``source_size``, ``weight``, ``target`` in words."""
    each = sized.groupBy("source", "key").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    ranked = with_row_number(each, [F.col("source").isNull(), F.col("source")], "place")
    ranked = materialize(ranked.withColumn("weight", F.col("place") % CYCLE + 1), "sources")
    most = MOST_COPIES * F.col("source_size")
    above: Column = F.lit(False)
    while True:  # share among the sources that are not at their limit, until none is above it
        sums = ranked.agg(
            F.sum("source_size"), F.sum(F.when(above, most).otherwise(0)), F.sum(F.when(above, 0).otherwise(F.col("weight"))), F.count_if(above)
        ).first()
        total, capped, weights, n_above = (x or 0 for x in sums)
        share = (total - capped) / weights if weights else 0.0
        wanted = F.col("weight") * F.lit(float(share))
        above = above | (wanted > most)
        if ranked.filter(above).count() == n_above:
            return ranked.withColumn("target", F.when(above, most.cast("double")).otherwise(wanted))


def _last_taken(queue: DataFrame, order: list[str], total: int):
    """The order values of the last row of the queue that the budget covers; None if it covers none."""
    ordered = with_row_order(queue, [F.col(c) for c in order], "_position")
    part = F.shiftright("_position", 33)
    sums = sorted(ordered.groupBy(part.alias("part")).agg(F.sum("size").alias("size")).collect())  # one row per sort partition
    before = 0
    for at, size in sums:
        if before + size > total:
            break
        before += size
    else:
        at, before = (sums[-1][0], before - sums[-1][1]) if sums else (0, 0)
    upto = F.sum("size").over(Window.orderBy("_position"))
    within = ordered.filter(part == at).withColumn("_upto", upto + before).filter(F.col("_upto") <= total)
    last = within.orderBy(F.desc("_position")).select(*order).first()
    if last is None and at:
        last = ordered.filter(part < at).orderBy(F.desc("_position")).select(*order).first()
    return last


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """What the mix takes of every row of ``docs``.

    ``id_col``, ``source``, ``size``, ``source_size``, ``target``, ``copies``, ``taken`` (``size`` times ``copies``). Documents
    are taken whole; a source ends within one document of its target. The shuffled order follows from the id alone, so
    reruns agree; rows with equal ids are ordered by size. A null source is a source; a null text has size zero. Rows of
    size zero are sent in their turn like others. An empty table gives an empty one.
    """
    with job(docs.sparkSession) as scope:
        mixed = _mixed(docs, id_col, text_col, source_col)
        names = ["source", "size", "source_size", "target", "copies", "taken"]
        return scope.keep(materialize(mixed.select(F.col("id").alias(id_col), *names), "mix"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that the mix takes, with ``mix_size``, ``mix_target``, ``mix_copies`` and ``mix_taken``.

    Rows equal in id and text are one row, whose copies are those of all. The mix is found, the rows not yet computed.
    """
    added = ["mix_size", "mix_target", "mix_copies", "mix_taken"]
    own_key, own_text, key, same_id, same_text = unused(docs, "row_key", "text_key", "taken_key", "taken_id", "taken_text")
    with job(docs.sparkSession) as scope:
        taken = _mixed(docs, id_col, text_col, source_col).filter("copies > 0").groupBy(F.col("id").alias(same_id), F.col("text_key").alias(same_text))
        taken = taken.agg(
            F.first("size").alias("mix_size"), F.first("target").alias("mix_target"), F.sum("copies").alias("mix_copies"), F.sum("taken").alias("mix_taken")
        )
        taken = scope.keep(materialize(taken.withColumn(key, row_key(F.col(same_id), F.col(same_text))), "taken"))
    kept = docs.drop(*added)  # columns of these names are replaced
    rows = kept.withColumn(own_text, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    rows = rows.withColumn(own_key, row_key(F.col(id_col), F.col(own_text)))
    same = (F.col(own_key) == F.col(key)) & F.col(id_col).eqNullSafe(F.col(same_id)) & (F.col(own_text) == F.col(same_text))
    return rows.join(taken, same).dropDuplicates([own_key, id_col, own_text]).select(*kept.columns, *added)


def _mixed(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    sized = materialize(_sized(docs, id_col, text_col, source_col), "sizes")
    wanted = materialize(targets(sized), "targets")
    total = wanted.agg(F.sum("source_size")).first()[0] or 0
    slices = F.substring("turn", 1, SLICE_DIGITS)
    rows = join_unique(sized.withColumn("slice", slices), wanted.drop("source"), "key", F.col("n")).drop("n", "key")
    sums = rows.groupBy("place", "slice").agg(F.sum("size").alias("slice_size"))
    earlier = Window.partitionBy("place").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("place", "slice", F.coalesce(F.sum("slice_size").over(earlier), F.lit(0)).alias("start"))
    within = Window.partitionBy("place", "slice").orderBy("turn", "id", "size", "text_key").rowsBetween(Window.unboundedPreceding, 0)
    sent = rows.join(starts, ["place", "slice"]).withColumn("sent", F.col("start") + F.sum("size").over(within))
    sent = materialize(sent.drop("slice", "start"), "sent")
    # a copy queues if its source is nearer to its target with it than without it
    upto = [F.col("sent") + k * F.col("source_size") for k in range(MOST_COPIES)]
    queues = [2 * u - F.col("size") < 2 * F.col("target") for u in upto]
    finish = [u / F.col("target") for u in upto]
    own = ["place", "turn", "id", "size", "text_key"]
    order = ["finish", *own, "copy"]
    copies = F.array(*[F.when(q, F.struct(F.lit(k).alias("copy"), f.alias("finish"))) for k, (q, f) in enumerate(zip(queues, finish))])
    queue = sent.select(*own, F.explode(F.array_compact(copies)).alias("c")).select(*own, "c.*")
    last = _last_taken(queue, order, total)
    taken = F.lit(0)
    if last is not None:
        cut = F.struct(*[F.lit(last[c]).cast(queue.schema[c].dataType).alias(c) for c in order])
        mine = [F.struct(f.alias("finish"), *own, F.lit(k).alias("copy")) <= cut for k, f in enumerate(finish)]
        taken = sum((F.when(q & m, 1).otherwise(0) for q, m in zip(queues, mine)), F.lit(0))
    return sent.withColumn("copies", taken.cast("int")).withColumn("taken", F.col("copies") * F.col("size"))


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, '')) AS turn FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1)::BIGINT AS place,
    ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight FROM sized GROUP BY source),
levels AS (
  SELECT *, 3 * source_size / weight AS level, (sum(source_size) OVER ())::BIGINT AS total,
    coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS capped,
    (sum(weight) OVER (ORDER BY 3 * source_size / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS open_weight
  FROM sources),
share AS (SELECT max((total - capped)::DOUBLE / open_weight) FILTER (level >= (total - capped)::DOUBLE / open_weight) AS value FROM levels),
targets AS (
  SELECT source, source_size, place, total,
    CASE WHEN weight * value > 3 * source_size THEN (3 * source_size)::DOUBLE ELSE weight * value END AS target FROM levels, share),
sent AS (
  SELECT doc_id, turn, size, t.*, (sum(size) OVER (PARTITION BY place ORDER BY turn, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT AS sent
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
queue AS (
  SELECT *, (sent + copy * source_size) / target AS finish FROM sent, (VALUES (0), (1), (2)) AS c(copy)
  WHERE 2 * (sent + copy * source_size) - size < 2 * target),
ordered AS (
  SELECT *, sum(size) OVER (ORDER BY finish, place, turn, doc_id, size, copy ROWS UNBOUNDED PRECEDING) AS upto FROM queue)
SELECT s.doc_id, s.source, s.size, s.source_size, s.target, count(o.copy)::INTEGER AS copies, (count(o.copy) * s.size)::BIGINT AS taken
FROM sent s LEFT JOIN ordered o ON o.doc_id = s.doc_id AND o.upto <= o.total
GROUP BY s.doc_id, s.source, s.size, s.source_size, s.target
"""
