"""The corpus pipeline: quality rules, near-duplicates, decontamination, personal data, mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mediatrends.llm.common import job
from mediatrends.llm.decontaminate import decontaminate
from mediatrends.llm.mixing import mix_documents
from mediatrends.llm.pii import mask_pii
from mediatrends.llm.quality import filter_quality
from mediatrends.llm.similar import keep_similar
from mediatrends.session import discard, materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return filter_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_similar(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mask_pii(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_documents(docs)


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixing", mixing),
]

# Fingerprints and windows are digests that DuckDB doesn't offer; the rows are tested against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    given = None
    with job(spark) as scope:
        for name, stage in STAGES:
            docs = materialize(stage(spark, docs, sf_dir), name)
            if given is not None:
                discard(given)
            given = docs
        return scope.keep(docs)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
