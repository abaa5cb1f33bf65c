"""Joins by effect, set operations and orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed


def lookup(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    return rows.join(table, key)


def shared_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys on both sides, once each; for a split these leak."""
    return a.select(key).intersect(b.select(key))


def absent_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).subtract(b.select(key))


def same_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row (equal): whether both sides have the same set of keys."""
    x, y = a.select(key, F.lit(1).alias("s")).distinct(), b.select(key, F.lit(2).alias("s")).distinct()
    sides = x.unionByName(y).groupBy(key).agg(F.count("*").alias("n"))
    return sides.agg((F.count_if(F.col("n") != 2) == 0).alias("equal"))


def pending(work: DataFrame, done: DataFrame, *key: str) -> DataFrame:
    """The work whose key is not done yet."""
    return work.join(done.select(*key), list(key), "left_anti")


def rerun_failures(results: DataFrame, selected: DataFrame, key: str, passed: str = "passed") -> DataFrame:
    """The results to keep when the failed ones among the selected run again."""
    failed = results.where(~F.coalesce(F.col(passed), F.lit(False))).join(selected.select(key), key, "left_semi").select(key).distinct()
    return results.join(failed, key, "left_anti")


def grid(tasks: DataFrame, languages: Sequence[str], name: str = "language") -> DataFrame:
    """Every task with every language: the languages come from a literal array, so nothing is joined."""
    return tasks.withColumn(name, F.explode(F.array(*[F.lit(x) for x in languages])))


def through_cache(rows: DataFrame, cache: DataFrame, key: str, value: str) -> DataFrame:
    """rows with ``value`` from the cache, null for misses, and ``hit``."""
    known = cache.select(F.col(key).alias("_key"), F.col(value), F.lit(True).alias("_hit"))
    return rows.join(known, F.col(key) == F.col("_key"), "left").drop("_key").withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("_hit")


def cache_misses(rows: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """The distinct keys that the cache lacks."""
    return rows.select(key).distinct().join(cache.select(key), key, "left_anti")


def in_order(rows: DataFrame, tasks: DataFrame, key: str, ordinal: str, language: str, languages: Sequence[str]) -> DataFrame:
    """The rows whose key and language are known, with ``language_ordinal`` and the tasks' ordinal for sorting."""
    place = F.array_position(F.array(*[F.lit(x) for x in languages]), F.col(language))
    return rows.where(F.col(language).isin(*languages)).join(tasks.select(key, ordinal), key).withColumn("language_ordinal", (place - 1).cast("int"))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def contains_any(docs: DataFrame, text: str, passages: DataFrame, passage: str, shingle: int = 4) -> DataFrame:
    """The docs that contain some passage as a substring.

    The words inside a passage, all but its first and last, which a match may cut, stand in the text as they are: passages of three
    words and more are found by an equi-join on the first of these, up to ``shingle`` of them, and then verified. Passages of one or
    two words, which have none, are compared with every text. The docs are written once and numbered, since they are read several times.
    """
    words = lambda c: F.split(c, r"\s+")
    named = passages.select(F.col(passage).alias("_p")).where(F.length("_p") > 0).distinct().withColumn("_w", words(F.col("_p")))
    inner = F.least(F.lit(shingle), F.size("_w") - 2)
    long = named.withColumn("_l", inner).where("_l > 0").select("_p", "_l", F.xxhash64("_l", F.slice("_w", F.lit(2), F.col("_l"))).alias("_s"))
    short = named.where(inner < 1).select("_p")
    keyed = checkpointed(docs.withColumn("_id", F.monotonically_increasing_id()))
    # Only numbers and hashes of shingles are joined; the texts come back for the few candidates.
    hashed = keyed.select("_id", words(F.col(text)).alias("_dw"))
    # At most ``shingle`` lengths.
    lengths = [r["_l"] for r in long.select("_l").distinct().collect()]
    none = F.array().cast("array<bigint>")

    def grams(n: int) -> Column:
        made = F.transform(F.sequence(F.lit(1), F.size("_dw") - n + 1), lambda i: F.xxhash64(F.lit(n), F.slice("_dw", i, n)))
        return F.coalesce(F.when(F.size("_dw") >= n, made), none)

    shingled = hashed.select("_id", F.explode_outer(F.array_distinct(F.concat(none, *[grams(n) for n in lengths]))).alias("_s"))
    candidates = shingled.join(long.select("_p", "_s"), "_s").select("_id", "_p").distinct().withColumnRenamed("_id", "_cid")
    found = keyed.join(candidates, F.col("_id") == F.col("_cid")).where(F.contains(F.col(text), F.col("_p"))).select("_id")
    if not short.isEmpty():
        found = found.unionByName(keyed.join(short, F.contains(F.col(text), F.col("_p")), "left_semi").select("_id"))
    return keyed.join(found.distinct(), "_id", "left_semi").drop("_id")


def ranked_top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def shortfall(df: DataFrame, wanted: int) -> DataFrame:
    """One row (found, wanted, short)."""
    return df.agg(F.count("*").alias("found")).select("found", F.lit(wanted).cast("long").alias("wanted"), F.greatest(F.lit(0), F.lit(wanted) - F.col("found")).alias("short"))
