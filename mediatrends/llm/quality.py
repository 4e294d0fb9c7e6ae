"""Quality rules whose limits follow from the data: quantile sketches by language and source.

A sketch is a histogram: the count of documents by metric and bin, for bins of fixed width. Counts add
up, so sketches of parts merge into the sketch of the whole, in any order and with the same result, and
a quantile is off by less than one bin. All metrics are whole numbers, so reruns agree exactly.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediatrends.llm.common import job, materialize, text_rows, type_of

# Fixed by the contract of the base rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
WINDOW = 3

# Metrics in whole thousandths (word length: hundredths of a character), with the bin width of their
# sketch, whether a low value is suspect too, and the distance from the median within which a value is
# never suspect, however uniform the group.
METRICS = {
    "word_length": {"bin": 5, "low": True, "slack": 200},
    "symbol_rate": {"bin": 1, "low": False, "slack": 20},
    "dup_line_rate": {"bin": 5, "low": False, "slack": 500},
    "repeat_rate": {"bin": 5, "low": False, "slack": 400},
    "capital_rate": {"bin": 2, "low": False, "slack": 200},
}
QUANTILES = {"low": 0.1, "mid": 0.5, "high": 0.9}
SPREAD = 4  # a limit lies this many times as far from the median as the 10 % or 90 % quantile
MIN_GROUP = 200  # a smaller group takes the merged sketch of its language, then of all documents

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals"]


def text_counts(text: str) -> tuple[int, ...]:
    """The values named in ``COUNTS`` for the whole text."""
    words = text.encode().split()
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line.encode().split()]
    triples = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(triples)) < len(triples):
        often = {t for t, k in Counter(triples).items() if k > 1}
        end = 0  # words before this position are counted
        for i, triple in enumerate(triples):
            if triple in often:
                repeated += i + WINDOW - max(end, i)
                end = i + WINDOW
    # letters that differ from their lower case, one for one
    lower = text.lower()
    capitals = sum(a != b for a, b in zip(text, lower)) if len(lower) == len(text) else sum(map(str.isupper, text))
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, len(lines), capitals


def _counted(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str, whole: bool = False) -> DataFrame:
    """``id``, ``lang``, ``source`` and the counts of every row; with ``whole`` also all its columns as the struct ``row``."""
    carried = ["id", "lang", "source", *["row"] * whole]

    def run(batches):
        for batch in batches:
            counts = zip(*map(text_counts, batch["text"].to_pylist())) if batch.num_rows else [[] for _ in COUNTS]
            columns = [*(batch[c] for c in carried), *(pa.array(c, pa.int64()) for c in counts)]
            yield pa.RecordBatch.from_arrays(columns, names=[*carried, *COUNTS])

    more = [F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source")]
    rows = text_rows(docs, id_col, text_col, *more, *[F.struct(*docs.columns).alias("row")] * whole)
    schema = f"id {type_of(docs, id_col)}, lang string, source string" + f", row {docs.schema.simpleString()}" * whole
    return rows.mapInArrow(run, schema + "".join(f", {c} bigint" for c in COUNTS))


def _metrics() -> dict[str, Column]:
    def share(part: str, whole: str, scale: int) -> Column:
        return F.expr(f"{scale} * {part} div greatest({whole}, 1)")

    return {
        "word_length": share("word_chars", "n_words", 100),
        "symbol_rate": share("n_symbols", "word_chars", 1000),
        "dup_line_rate": share("n_dup_lines", "n_lines", 1000),
        "repeat_rate": share("n_repeat_words", "n_words", 1000),
        "capital_rate": share("n_capitals", "word_chars", 1000),
    }


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def sketches(counted: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``metric``, ``bin``, ``n`` over the rows that pass the base rules."""
    metrics = [F.struct(F.lit(m).alias("metric"), (v / METRICS[m]["bin"]).cast("bigint").alias("bin")) for m, v in _metrics().items()]
    each = counted.filter(~base_failed()).select("lang", "source", F.explode(F.array(*metrics)).alias("m"))
    return each.groupBy("lang", "source", "m.metric", "m.bin").agg(F.count(F.lit(1)).alias("n"))


def merged(sketch: DataFrame, *keys: str) -> DataFrame:
    """The sketches of the coarser groups ``keys``."""
    return sketch.groupBy(*keys, "metric", "bin").agg(F.sum("n").alias("n"))


def sketch_quantiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """``keys``, ``metric``, ``size`` and the lower edge of the bin of each quantile, as ``low``, ``mid``, ``high``."""
    group = Window.partitionBy(*keys, "metric")
    ranked = sketch.withColumn("upto", F.sum("n").over(group.orderBy("bin"))).withColumn("size", F.sum("n").over(group))
    width = F.create_map(*[F.lit(x) for m, s in METRICS.items() for x in (m, s["bin"])])
    reached = {q: F.min(F.when(1000 * F.col("upto") >= int(1000 * p) * F.col("size"), F.col("bin"))) for q, p in QUANTILES.items()}
    found = ranked.groupBy(*keys, "metric", "size").agg(*[v.alias(q) for q, v in reached.items()])
    return found.select(*keys, "metric", "size", *[(F.col(q) * width[F.col("metric")]).alias(q) for q in QUANTILES])


def limits(sketch: DataFrame) -> DataFrame:
    """One row per language and source: for each metric the least and the greatest value that is kept."""
    slack = F.create_map(*[F.lit(x) for m, s in METRICS.items() for x in (m, s["slack"])])
    own = sketch_quantiles(sketch, "lang", "source").alias("own")
    by_lang = sketch_quantiles(merged(sketch, "lang"), "lang").alias("by_lang")
    overall = sketch_quantiles(merged(sketch)).alias("overall")
    metric = F.col("own.metric")
    joined = own.join(by_lang, F.col("own.lang").eqNullSafe(F.col("by_lang.lang")) & (metric == F.col("by_lang.metric")))
    joined = joined.join(F.broadcast(overall), metric == F.col("overall.metric"))  # one row per metric

    def pick(q: str) -> Column:
        return F.when(F.col("own.size") >= MIN_GROUP, F.col(f"own.{q}")).when(
            F.col("by_lang.size") >= MIN_GROUP, F.col(f"by_lang.{q}")
        ).otherwise(F.col(f"overall.{q}"))

    found = joined.select("own.lang", "own.source", metric.alias("metric"), *[pick(q).alias(q) for q in QUANTILES])
    room = slack[F.col("metric")]
    found = found.withColumn("least", F.col("mid") - F.greatest(SPREAD * (F.col("mid") - F.col("low")), room)).withColumn(
        "most", F.col("mid") + F.greatest(SPREAD * (F.col("high") - F.col("mid")), room)
    )
    each = [F.max(F.when(F.col("metric") == m, F.col(side))).alias(f"{side}_{m}") for m in METRICS for side in ("least", "most")]
    return found.groupBy("lang", "source").agg(*each)


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """Counts and verdict of every row of ``docs``.

    ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``base_failed``, ``kept`` and
    ``failed_metrics``, the metrics outside the limits of the row's language and source. A null text has no word
    and fails. Null languages and sources form groups of their own; groups below ``MIN_GROUP`` rows take the merged
    sketch of the language or of all rows. Repeated rows count as often as they occur and get the same verdict.
    """
    with job(docs.sparkSession) as scope:
        counted = materialize(_counted(docs, id_col, text_col, lang_col, source_col), "counts")
        judged = _judged(counted, limits(materialize(sketches(counted), "sketches")))
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_metrics"]
        return scope.keep(materialize(judged.select(F.col("id").alias(id_col), *names), "quality"))


def filter_quality(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, not yet computed. Texts are counted twice instead of being shuffled."""
    with job(docs.sparkSession) as scope:
        columns = (docs, id_col, text_col, lang_col, source_col)
        found = scope.keep(materialize(limits(materialize(sketches(_counted(*columns)), "sketches")), "limits"))
        return _judged(_counted(*columns, whole=True), found).filter("kept").select("row.*")


def _judged(counted: DataFrame, found: DataFrame) -> DataFrame:
    same = counted["lang"].eqNullSafe(found["lang"]) & counted["source"].eqNullSafe(found["source"])
    # one row per language and source: Spark broadcasts the limits if they are few
    rows = counted.join(found, same, "left").drop(found["lang"]).drop(found["source"])
    outside = [
        F.when(value > F.col(f"most_{m}"), m).when(F.lit(METRICS[m]["low"]) & (value < F.col(f"least_{m}")), m)
        for m, value in _metrics().items()
    ]
    failed = F.array_join(F.array(*outside), ",")
    return rows.withColumns({"base_failed": base_failed(), "failed_metrics": failed}).withColumn("kept", ~F.col("base_failed") & (F.col("failed_metrics") == ""))
