"""Deterministic splits, quotas, samples and expansions.

Order is by hash of a seed and the key, so results do not depend on partitioning. Ranks in that order come from
sorted ranges and offsets (``ranks``): no window holds a lane or a part of one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from .ranks import ranked

def split(key: Column, buckets: int = 20) -> Column:
    """"validation" for bucket 0 of ``buckets``, else "train"; all rows of a key lie on one side."""
    return F.when(X.hash_bucket(key, buckets) == 0, "validation").otherwise("train")


def hash_rank(df: DataFrame, key: str, seed: int, by: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """df with each row's place, from 1, in hash order within ``by``. Ties of the key keep any order among themselves."""
    return ranked(df.withColumn("_order", X.hash_order(F.col(key), seed)), ["_order", key], by, name).select(*df.columns, name)


def quotas(total: int, ratios: Mapping[str, float], rest: str) -> dict[str, int]:
    """round(total * ratio), half to even, for each name; ``rest`` takes what remains."""
    made = {name: round(total * ratio) for name, ratio in ratios.items() if name != rest}
    return made | {rest: total - sum(made.values())}


def split_sizes(total: int, fraction: float) -> dict[str, int]:
    held = round(total * fraction)
    return {"train": total - held, "validation": held}


def round_robin(tasks: DataFrame, key: str, lanes: Mapping[str, int], seed: int) -> DataFrame:
    """Rows (lane, index, variant, key): row ``index`` of a lane takes task index mod T and variant index div T, T tasks in hash order.

    A lane's quota must reach the number of tasks; see ``uncovered_lanes``.
    """
    spark = tasks.sparkSession
    ranked = hash_rank(tasks.select(key).distinct(), key, seed)
    count = ranked.agg(F.count("*").alias("t"))
    quota = spark.createDataFrame(list(lanes.items()), "lane string, quota long")
    rows = quota.crossJoin(count).where("t > 0")
    # A task appears once per variant; its rows are made from the task's side, so nothing is joined on a constant.
    made = ranked.crossJoin(F.broadcast(rows)).withColumn("n", F.expr("(quota - rank) div t + 1")).where(F.col("rank") <= F.col("quota"))
    made = made.select("lane", key, "rank", "t", F.explode(F.expr("sequence(0L, n - 1)")).alias("variant"))
    return made.select("lane", (F.col("variant") * F.col("t") + F.col("rank") - 1).alias("index"), F.col("variant"), key)


def uncovered_lanes(task_count: int, lanes: Mapping[str, int]) -> list[str]:
    return [lane for lane, quota in lanes.items() if quota < task_count]


def stratified(df: DataFrame, key: str, lane: str, wanted: Column, total: int, ratios: Mapping[str, float], least: float, seed: int) -> DataFrame:
    """About ``total`` rows: in each lane its quota, of which a part ``least`` has ``wanted`` if there are so many; filled up from the rest.

    The lane's other rows fill its quota, then more wanted ones; lanes that fall short are made good from all unselected rows.
    """
    ranked = hash_rank(df.withColumn("_wanted", F.coalesce(wanted, F.lit(False))), key, seed, [lane, "_wanted"], "_rank")
    sizes = ranked.groupBy(lane).agg(F.count_if("_wanted").alias("_w"), F.count_if(~F.col("_wanted")).alias("_o"))
    quota = F.coalesce(*[F.when(F.col(lane) == k, F.lit(round(total * r))) for k, r in ratios.items()], F.lit(0))
    sizes = sizes.withColumn("_q", quota.cast("long")).withColumn("_first", F.least(F.bround(F.col("_q") * F.lit(least)).cast("long"), F.col("_w")))
    sizes = sizes.withColumn("_second", F.least(F.greatest(F.col("_q") - F.col("_first"), F.lit(0)), F.col("_o")))
    sizes = sizes.withColumn("_third", F.least(F.col("_q") - F.col("_first") - F.col("_second"), F.col("_w") - F.col("_first")))
    joined = ranked.join(F.broadcast(sizes.withColumnRenamed(lane, "_lane")), F.col(lane) == F.col("_lane")).drop("_lane")
    chosen = F.when(F.col("_wanted"), F.col("_rank") <= F.col("_first") + F.col("_third")).otherwise(F.col("_rank") <= F.col("_second"))
    marked = joined.withColumn("_chosen", chosen)
    selected = marked.where("_chosen").select(*df.columns)
    short = sizes.agg((F.lit(total) - F.coalesce(F.sum(F.col("_first") + F.col("_second") + F.col("_third")), F.lit(0))).alias("short"))
    rest = hash_rank(marked.where("NOT _chosen").select(*df.columns), key, seed + 1, name="_rank")
    extra = rest.crossJoin(F.broadcast(short)).where("_rank <= short").select(*df.columns)
    return selected.unionByName(extra)


def feasible_total(counts: Mapping[str, int], ratios: Mapping[str, float], block: int = 20) -> int:
    """The most rows, a multiple of the block, that the lanes' counts allow at the ratios."""
    return min(int(counts.get(k, 0) / r) for k, r in ratios.items()) // block * block


def interleave(df: DataFrame, key: str, lane: str, per_block: Mapping[str, int], seed: int) -> DataFrame:
    """The largest set of whole blocks, each with per_block rows of every lane, with columns block and place in it (from 0)."""
    ranked = hash_rank(df.where(F.col(lane).isin(*per_block)), key, seed, [lane], "_rank")
    size = F.coalesce(*[F.when(F.col(lane) == k, F.lit(n)) for k, n in per_block.items()])
    blocks = ranked.groupBy(lane).agg(F.floor(F.count("*") / F.first(size)).alias("b")).agg(F.when(F.count("*") == len(per_block), F.min("b")).otherwise(F.lit(0)).alias("blocks"))
    placed = ranked.withColumn("block", F.floor((F.col("_rank") - 1) / size)).crossJoin(F.broadcast(blocks)).where("block < blocks")
    place = F.row_number().over(W.partitionBy("block").orderBy(X.hash_order(F.concat_ws(":", "block", key), seed), key)) - 1
    return placed.withColumn("place", place).select(*df.columns, "block", "place")


def upsample(df: DataFrame, which: Column, copies: int) -> DataFrame:
    """df, with copies 2 to ``copies`` of the rows that match, numbered in ``repeat``; the originals have null."""
    base = df.withColumn("repeat", F.lit(None).cast("int"))
    if copies < 2:
        return base
    more = df.where(which).withColumn("repeat", F.explode(F.sequence(F.lit(2), F.lit(copies))))
    return base.unionByName(more)


def take(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).limit(n)
