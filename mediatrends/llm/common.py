"""Helpers shared by the operators on documents."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediatrends.session import materialize, scratch_scope

# The characters that separate words: space, tab, line feed, vertical tab, form feed, return.
# Python's bytes.split() splits at the same six.
WORD = r"[^\x20\x09-\x0D]+"

@contextmanager
def settings(spark: SparkSession, **wanted: str) -> Iterator[None]:
    """Session settings that hold inside the block; ``__`` in a name stands for a dot."""
    names = {k.replace("__", "."): v for k, v in wanted.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


@contextmanager
def job(spark: SparkSession):
    """Scratch tables made inside are deleted, except those kept; shuffle files live as long as their job.

    Jobs that end in a written table never read their shuffle files again, so an operator of several
    such jobs needs the disk of its largest job, not of all of them.
    """
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"), scratch_scope(spark) as scope:
        yield scope


def text_rows(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """The id as ``id``, the text as ``text`` with null as empty, and ``more``; nothing else is read."""
    return df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)


def type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def unused(df: DataFrame, *names: str) -> list[str]:
    """The ``names``, each lengthened until no column of ``df`` is called so, in any case."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def row_key(id_: Column, text_key: Column) -> Column:
    """One number, never null, for an id that may be null and the hash of a text."""
    return F.xxhash64(id_, text_key)


def join_unique(left: DataFrame, right: DataFrame, key: str, weight: Column, how: str = "inner", hot_keys: int = 1000) -> DataFrame:
    """Join ``left`` with ``right``, which has one row per ``key``, when keys of ``left`` may be hot.

    ``weight`` is the number of left rows of a right row's key. Keys that hold more than one in
    ``hot_keys`` of all left rows are fewer than ``hot_keys``; their right rows are broadcast, so
    their left rows stay where they are. The other keys are shuffled.
    """
    total = right.agg(F.sum(weight)).scalar()
    hot = weight * hot_keys > total
    few = right.filter(hot).withColumn("_hot", F.lit(True))
    marked = left.join(F.broadcast(few.select(key, "_hot")), key, "left")  # fewer than hot_keys rows
    rest = marked.filter("_hot IS NULL").drop("_hot").join(right.filter(~hot), key, how)
    return marked.filter("_hot").drop("_hot").join(F.broadcast(few.drop("_hot")), key).unionByName(rest)


__all__ = ["WORD", "job", "join_unique", "materialize", "row_key", "settings", "text_rows", "type_of", "unused"]
