"""Sinks: JSON lines, one-document JSON, text blocks and the cache table. All go through Spark's committers."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import cache_misses
from . import files


def write_jsonl(df: DataFrame, path: str) -> None:
    """A folder of JSON-lines files; characters outside ASCII are written as they are."""
    df.write.mode("overwrite").json(path)


def write_document(row: DataFrame, path: str) -> None:
    """A one-row frame as a JSON object with two-space indentation."""
    row.select(F.to_json(F.struct(*row.columns), {"pretty": "true"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_array(df: DataFrame, path: str, *order: str) -> None:
    """A small table as one JSON array of objects, in order; it is gathered in one row."""
    rows = F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), F.struct(*df.columns).alias("r"))))
    write_file(df.agg(F.to_json(F.transform(rows, lambda x: x["r"])).alias("value")), path)


def write_file(row: DataFrame, path: str) -> None:
    """The text of a one-row frame (value) as one file named ``path``, which appears whole or not at all.

    It is written beside, under a name of its own, and takes the place of an older file of the name by one rename.
    """
    spark = row.sparkSession
    part = f"{path}.{uuid.uuid4().hex}"
    row.coalesce(1).write.option("lineSep", "\n").text(part)
    written = next(n for n in files.names(spark, part) if n.startswith("part-"))
    files.rename(spark, f"{part}/{written}", path, overwrite=True)
    files.delete(spark, part)


def write_blocks(df: DataFrame, block: str, order: Sequence[str], path: str) -> None:
    """Text blocks in order, a blank line between any two."""
    df.orderBy(*order).select(F.concat(F.col(block), F.lit("\n")).alias("value")).write.mode("overwrite").text(path)


def append_to_cache(computed: DataFrame, cache: DataFrame, key: str, value: str, path: str) -> None:
    """Appends the values of keys that the cache at ``path`` lacks; doing it again adds nothing."""
    new = computed.select(key, value).dropDuplicates([key])
    new.join(cache_misses(new, cache, key), key).write.mode("append").parquet(path)
