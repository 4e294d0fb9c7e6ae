"""URL filters: rules decide the URLs they fit, gradient-boosted trees on lexical features the others.

The trees learn from the URLs that rules have labelled. Everything is DataFrame functions and Spark's
own tree ensemble.
"""

from __future__ import annotations

import string

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediatrends.llm.common import job, materialize

# Fixed by the contract: (verdict, host and path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

TRAIN_ROWS = 20_000  # labelled URLs that the trees are fitted on, at most
TREES = 20
DEPTH = 4
SMOOTHING = 20.0  # rows of the overall block rate that are added to each suffix

_LETTERS = string.ascii_uppercase


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    host = F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, _LETTERS, _LETTERS.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule (host and path) that fits, as written; null if none does."""
    found: Column = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        rule_host, _, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(f"/{rest}")
        found = F.when(fits, rule).otherwise(found)
    return found


def _entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    n = F.length(text)

    def add(total: Column, char: Column) -> Column:
        share = (n - F.length(F.replace(text, char, F.lit("")))) / n
        return total - share * F.log2(share)

    chars = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    return F.when(n > 0, F.aggregate(chars, F.lit(0.0), add)).otherwise(0.0)


def _count(text: Column, char: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))).cast("double")


def _digit_share(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, string.digits, ""))) / F.greatest(F.length(text), F.lit(1))


def features() -> dict[str, Column]:
    """Lexical features of the columns ``url``, ``host`` and ``path``."""
    url, host, path = F.col("url"), F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    labels = F.split(host, r"\.")
    return {
        "url_length": F.length(url).cast("double"),
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "depth": F.size(F.filter(F.split(path, "/"), lambda s: s != "")).cast("double"),
        "host_labels": F.size(labels).cast("double"),
        "longest_label": F.array_max(F.transform(labels, F.length)).cast("double"),
        "first_step_length": F.length(F.split_part(path, F.lit("/"), F.lit(2))).cast("double"),
        "digit_share": _digit_share(url),
        "path_digit_share": _digit_share(path),
        "url_entropy": _entropy(url),
        "host_entropy": _entropy(host),
        "hyphens": _count(host, "-"),
        "parameters": F.when(F.length(query) > 0, _count(query, "&") + 1).otherwise(0.0),
        "values": _count(query, "="),
        "has_fragment": F.contains(url, F.lit("#")).cast("double"),
        "is_secure": F.lower(url).startswith("https:").cast("double"),
        "has_extension": path.rlike(r"\.[A-Za-z0-9]{1,5}$").cast("double"),
        "starts_www": host.startswith("www.").cast("double"),
    }


def _suffix(n: int) -> Column:
    return F.substring_index("host", ".", -n)


def _with_suffix_statistics(rows: DataFrame, overall: float) -> DataFrame:
    """Per host suffix of one and two labels: how frequent it is, and the smoothed share of its rule-labelled URLs that are blocked."""
    for n in (1, 2):
        known = F.col("label").isNotNull()
        stats = rows.groupBy(_suffix(n).alias(f"suffix_{n}")).agg(
            F.log1p(F.count(F.lit(1))).alias(f"suffix_{n}_log_count"),
            ((F.sum(F.when(known, F.col("label")).otherwise(0.0)) + SMOOTHING * overall) / (F.count_if(known) + SMOOTHING)).alias(f"suffix_{n}_block_rate"),
        )
        # one row per suffix; Spark broadcasts it if it is small, and splits frequent suffixes otherwise
        rows = rows.withColumn(f"suffix_{n}", _suffix(n)).join(materialize(stats, "suffixes"), f"suffix_{n}").drop(f"suffix_{n}")
    return rows


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """Verdict on every row of ``pages``.

    ``id_col``, ``host``, ``path``, ``rule`` (the longest that fits, or null), ``verdict`` (``block`` or ``allow``) and
    ``block_probability`` (null where a rule decides). The trees are fitted on at most ``TRAIN_ROWS`` URLs that rules
    decide, chosen by a hash of the URL. A null URL has empty host and path. If rules give only one verdict, or
    none, the others get that verdict, or ``allow``.
    """
    with job(pages.sparkSession) as scope:
        url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
        rows = pages.select(F.col(id_col).alias("id"), url.alias("url")).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
        rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
        blocked = [rule for verdict, rule in rules if verdict == "block"]
        label = F.when(F.col("rule").isNotNull(), F.when(F.col("rule").isin(blocked), 1.0).otherwise(0.0))
        rows = materialize(rows.withColumn("label", label), "urls")
        n_known, n_blocked = rows.agg(F.count("label"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
        if 0 < n_blocked < n_known:
            own = features()
            described = materialize(_with_suffix_statistics(rows, n_blocked / n_known).withColumns(own), "url_features")
            columns = [*own, *[f"suffix_{n}_{s}" for n in (1, 2) for s in ("log_count", "block_rate")]]
            vectors = VectorAssembler(inputCols=columns, outputCol="features")
            chosen = described.filter("label IS NOT NULL").orderBy(F.xxhash64("url"), "url", "id").limit(TRAIN_ROWS)
            known = materialize(vectors.transform(chosen).select("features", "label"), "labelled_urls")
            trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7).fit(known)
            judged = trees.transform(vectors.transform(described))
            share = F.when(F.col("rule").isNull(), F.round(vector_to_array("probability")[1], 6))
            judged = judged.withColumn("share", share)
        else:
            judged = rows.withColumn("share", F.when(F.col("rule").isNull(), 1.0 if n_known and n_blocked == n_known else 0.0))
        verdict = F.when(F.coalesce("label", "share") >= 0.5, "block").otherwise("allow")
        result = judged.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), F.col("share").alias("block_probability"))
        return scope.keep(materialize(result, "verdicts"))
