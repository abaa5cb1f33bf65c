"""One row per key, with a defined winner.

min_by and max_by combine on the map side, so a key with very many rows is never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def _winner(df: DataFrame, key: Column | str, order: Column, best) -> DataFrame:
    key = F.col(key) if isinstance(key, str) else key
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(key.alias("_key")).agg(best(row, order).alias("_row")).select("_row.*")


def keep_first(df: DataFrame, key: Column | str, *order: str) -> DataFrame:
    """The row of the least order of each key. Null keys are one key; equal rows are one."""
    return _winner(df, key, F.struct(*order), F.min_by)


def keep_last(df: DataFrame, key: Column | str, *order: str) -> DataFrame:
    return _winner(df, key, F.struct(*order), F.max_by)


def dedup_text(df: DataFrame, text: str, *order: str) -> DataFrame:
    """The first row of each text, case and white space aside."""
    return keep_first(df, X.dedup_key(F.col(text)), *order)


def first_value(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    return df.groupBy(key).agg(F.min_by(value, order).alias(value))


def last_value(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))


def merge_runs(runs: list[DataFrame], *key: str, source: str = "source_run") -> DataFrame:
    """Rows of several runs, the later run's row of a key in place of the earlier's; ``source`` tells which run it is from (from 0)."""
    tagged = [df.withColumn(source, F.lit(i)) for i, df in enumerate(runs)]
    united = tagged[0]
    for df in tagged[1:]:
        united = united.unionByName(df, allowMissingColumns=True)
    return keep_last(united, F.struct(*key), source)
