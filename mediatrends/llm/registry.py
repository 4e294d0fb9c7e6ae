"""Queries of the operators on documents, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mediatrends.llm import chat_format, licenses, mixing, ranked_search
from mediatrends.llm.decontaminate import contaminated
from mediatrends.llm.pii import find_pii
from mediatrends.llm.quality import quality_rules
from mediatrends.llm.secrets import secret_digests
from mediatrends.llm.simhash import simhash_components
from mediatrends.llm.suffix_dedup import remove_repeats
from mediatrends.llm.toxicity import toxicity
from mediatrends.llm.url_filter import filter_urls
from mediatrends.llm.whitening import whiten


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return remove_repeats(table(spark, sf, "documents"))


def op2_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality_rules(table(spark, sf, "documents"))


def op3_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf, "documents"))


def op4_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return filter_urls(table(spark, sf, "pages"))


def op5_pii(spark: SparkSession, sf: str) -> DataFrame:
    return find_pii(table(spark, sf, "documents"))


def op10_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op6_licenses(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf, "documents"))


def op7_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash_components(table(spark, sf, "documents"))


def op8_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    given = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.formatted_digests(given.unionByName(chat_format.example(spark)))


def op9_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op11_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return secret_digests(table(spark, sf, "documents"))


def op12_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whiten(table(spark, sf, "embeddings"))


def op13_ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    return ranked_search.ranked_search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_quality": op2_quality,
        "op3_mixing": op3_mixing,
        "op4_url_filter": op4_url_filter,
        "op5_pii": op5_pii,
        "op6_licenses": op6_licenses,
        "op7_simhash": op7_simhash,
        "op8_chat_format": op8_chat_format,
        "op9_toxicity": op9_toxicity,
        "op10_decontamination": op10_decontamination,
        "op11_secrets": op11_secrets,
        "op12_whitening": op12_whitening,
        "op13_ranked_search": op13_ranked_search,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": mixing.SQL, "op6_licenses": licenses.SQL, "op8_chat_format": chat_format.SQL, "op13_ranked_search": ranked_search.SQL}
