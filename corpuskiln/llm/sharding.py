"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``CELLS`` equal cells; a shard's virtual nodes sit at cells given by a hash of shard
and replica, and a key lies in the cell of its hash. A key belongs to the next virtual node
clockwise whose shard is not full; a full shard's overflow continues clockwise, so every shard
holds at most its bound and keys move only where a bound forces them.

Rows are placed in the order (cell in ring order from a fixed start, hash, doc_id): what that order gives is
decided for whole cells from their counts, since rows of a cell walk the same way. Only the
``CELLS`` counts, a bound that does not grow with the data, reach the driver, and at most
``CELLS`` + shards runs (cell, ranks, shard, first slot) go back. The rows themselves are ranked
inside their cells, never inside a shard, so there are thousands of independent tasks.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import ranked
from .common import table

CELL_BITS = 12
CELLS = 1 << CELL_BITS
REPLICAS = 64


def ring(shards: int, replicas: int = REPLICAS) -> list[tuple[int, int]]:
    """(cell, shard) of each virtual node, in ring order; adding a shard leaves the others' nodes."""
    nodes = [(int.from_bytes(hashlib.sha256(f"{s}:{r}".encode()).digest()[:8], "big") % CELLS, s) for s in range(shards) for r in range(replicas)]
    return sorted(nodes)


def bounds(total: int, shards: int, load: float = 1.0) -> list[int]:
    """Rows that each shard may hold: ceil(load * mean), or with load 1 shares at most one row apart."""
    if load <= 1.0:
        return [total // shards + (s < total % shards) for s in range(shards)]
    return [-int(-(load * total) // shards)] * shards


def place(counts: dict[int, int], shards: int, load: float = 1.0) -> list[tuple[int, int, int, int, int]]:
    """Runs (cell, first rank, last rank, shard, slot of the first) for the counts of the cells."""
    nodes = ring(shards)
    cells = [c for c, _ in nodes]
    bound = bounds(sum(counts.values()), shards, load)
    used, runs = [0] * shards, []
    for cell in sorted(counts):
        rank, left, at = 1, counts[cell], bisect_left(cells, cell)
        step = 0
        while left and step < len(nodes):
            shard = nodes[(at + step) % len(nodes)][1]
            step += 1
            if take := min(left, bound[shard] - used[shard]):
                runs.append((cell, rank, rank + take - 1, shard, used[shard]))
                used[shard] += take
                rank, left = rank + take, left - take
    return runs


RUNS = "_r_cell int, _r_first long, _r_last long, shard int, _r_slot long"


def shard_rows(docs: DataFrame, shards: int, load: float = 1.0) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, size, text_crc32, shard, slot (gapless from 0 in a shard).

    Size is the text's UTF-8 bytes plus 1 (null: 1). Rows with equal doc_id lie in the same cell, those with a null
    doc_id in that of their text; equal rows are interchangeable and each gets its own slot. Ranks within a cell come from sorted
    ranges and offsets, so a cell that holds a third of all rows is no single task. An empty table gives an empty result. The same
    rows give the same shards in any partitioning.
    """
    spark = docs.sparkSession
    place_of = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit("text"), F.col("text"))).otherwise(F.xxhash64(F.col("doc_id").cast("long")))
    cell = F.shiftrightunsigned(place_of, 64 - CELL_BITS).cast("int")
    counts = {r["cell"]: r["n"] for r in docs.groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).collect()}
    runs = F.broadcast(spark.createDataFrame(place(counts, shards, load), RUNS))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), place_of.alias("_at"), cell.alias("_cell"))
    placed = ranked(rows, ["_at", "doc_id", "text_crc32", "size"], ["_cell"], "_rank")
    held = (F.col("_cell") == F.col("_r_cell")) & F.col("_rank").between(F.col("_r_first"), F.col("_r_last"))
    return placed.join(runs, held).select("doc_id", "size", "text_crc32", "shard", (F.col("_r_slot") + F.col("_rank") - F.col("_r_first")).alias("slot"))


SHARDS = 8


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_rows(table(spark, sf_dir, "documents", "doc_id", "text"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
