"""Exact medians without a group's values in one place: ranges around the wanted rank are narrowed until few values are left."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

#: Values of a group that one buffer may hold; a group with no more is not narrowed.
FEW = 10_000
#: Groups with more than ``FEW`` values that may be broadcast; ``FEW`` grows when a table could have more.
MOST_GROUPS = 100_000
#: Cuts of a range in one pass.
CUTS = 256


def medians(df: DataFrame, value: Column, by: Sequence[str], name: str = "median", few: int = FEW) -> DataFrame:
    """The median of the values that are not null, by group: the middle one, or the mean of the two in the middle.

    A pass takes estimated quantiles of the range that holds a rank, whose sketch has a bounded size, and counts what lies below,
    at and between the two cuts around the rank. Counts are exact, so an estimate that is off costs a pass, not the result. When
    at most ``few`` values of a group are in its range, they are sorted. Groups without values have no row; a null
    group is one.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    values = checkpointed(df.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], value.cast("double").alias("_v")).where("_v IS NOT NULL"))
    sizes = values.groupBy(*keys).agg(F.count("*").alias("_n"))
    few = max(few, (values.count() + MOST_GROUPS - 1) // MOST_GROUPS)
    # The ranks of the middle, one or two; _lo and _hi bound the values among which it is, both excluded, and _left is the rank there.
    ranks = F.array_distinct(F.array(F.expr("(_n + 1) div 2"), F.expr("_n div 2 + 1")))
    none = F.lit(None).cast("double")
    targets = sizes.select(*keys, F.explode(ranks).alias("_rank"), "_n").select(*keys, "_rank", F.col("_rank").alias("_left"), F.col("_n").alias("_inside"), none.alias("_lo"), none.alias("_hi"), none.alias("_found"))

    def inside(rows: DataFrame, wanted: DataFrame) -> DataFrame:
        """The values in the ranges of the wanted ranks, whose groups have more than ``few`` values, so that there are at most ``MOST_GROUPS``."""
        same = (F.col("_lo").isNull() | (F.col("_v") > F.col("_lo"))) & (F.col("_hi").isNull() | (F.col("_v") < F.col("_hi")))
        for k in keys:
            same &= F.col(k).eqNullSafe(F.col(f"_t{k}"))
        return rows.join(F.broadcast(wanted.withColumnsRenamed({k: f"_t{k}" for k in keys})), same).drop(*[f"_t{k}" for k in keys])

    targets = checkpointed(targets)
    large = targets.where(F.col("_inside") > few)
    done = []
    while not large.isEmpty():
        at = F.greatest(F.least(F.floor(F.col("_left") / F.col("_inside") * CUTS).cast("int"), F.lit(CUTS - 1)), F.lit(1))
        cuts = inside(values, large).groupBy(*keys, "_rank", "_left", "_inside", "_lo", "_hi").agg(F.percentile_approx("_v", [k / CUTS for k in range(CUTS + 1)], 4 * CUTS).alias("_q"))
        cuts = checkpointed(cuts.select(*keys, "_rank", "_left", "_lo", "_hi", F.get("_q", at - 1).alias("_a"), F.get("_q", at + 1).alias("_b")))
        v, a, b = F.col("_v"), F.col("_a"), F.col("_b")
        n = inside(values, cuts).groupBy(*keys, "_rank", "_left", "_lo", "_hi", "_a", "_b").agg(F.count_if(v < a).alias("_below"), F.count_if(v == a).alias("_at_a"), F.count_if((v > a) & (v < b)).alias("_between"), F.count_if((v == b) & (a < b)).alias("_at_b"), F.count_if(v > b).alias("_above"))
        left, t0 = F.col("_left"), F.col("_below")
        t1 = t0 + F.col("_at_a")
        t2 = t1 + F.col("_between")
        t3 = t2 + F.col("_at_b")
        pick = lambda below, at_a, between, at_b, above: F.when(left <= t0, below).when(left <= t1, at_a).when(left <= t2, between).when(left <= t3, at_b).otherwise(above)
        step = n.select(
            *keys, "_rank", pick(left, left, left - t1, left, left - t3).alias("_left"), pick(t0, F.lit(0), F.col("_between"), F.lit(0), F.col("_above")).alias("_inside"),
            pick(F.col("_lo"), none, a, none, b).alias("_lo"), pick(a, none, b, none, F.col("_hi")).alias("_hi"), pick(none, a, none, b, none).alias("_found"),
        )
        step = checkpointed(step)
        done.append(step.where((F.col("_inside") <= few) | F.col("_found").isNotNull()))
        large = step.where((F.col("_inside") > few) & F.col("_found").isNull())
    # Groups that were never narrowed need no join: their values are sorted where they meet.
    picks = F.transform("_ranks", lambda r: F.get("_sorted", (r - 1).cast("int")))
    few_values = values if not done else _others(values, targets.where(F.col("_inside") > few).select(*keys).distinct(), keys)
    middle = few_values.groupBy(*keys).agg(F.sort_array(F.collect_list("_v")).alias("_sorted")).withColumn("_n", F.size("_sorted")).withColumn("_ranks", ranks).select(*keys, F.explode(picks).alias("_found"))
    for part in done:
        middle = middle.unionByName(part.where("_found IS NOT NULL").select(*keys, "_found"))
        rest = inside(values, part.where("_found IS NULL")).groupBy(*keys, "_rank", "_left").agg(F.sort_array(F.collect_list("_v")).alias("_sorted"))
        middle = middle.unionByName(rest.select(*keys, F.get("_sorted", (F.col("_left") - 1).cast("int")).alias("_found")))
    found = middle.groupBy(*keys).agg((F.sum("_found") / F.count("_found")).alias(name))
    return found.select(*[F.col(k).alias(c) for c, k in zip(by, keys)], name)


def _others(values: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The values of other groups than these, which are few."""
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_t{k}"))
    return values.join(F.broadcast(groups.withColumnsRenamed({k: f"_t{k}" for k in keys})), same, "left_anti")
