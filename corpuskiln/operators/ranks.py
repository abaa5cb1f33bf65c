"""Ranks over whole tables without a window over a group: sorted ranges, whose sizes are summed to offsets."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import checkpointed

#: Rows that one sorted range should hold.
RANGE_ROWS = 1_000_000
#: monotonically_increasing_id has the row's place in its partition in so many low bits.
PLACE_BITS = 33


def ranked(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), name: str = "rank", descending: Sequence[str] = (), range_rows: int = RANGE_ROWS) -> DataFrame:
    """df with each row's place, from 1, within its group ``by`` in the order of the columns ``order``.

    The table is sorted into ranges, as many as its count asks for, and written once. The rows of a range are numbered
    as they lie; sums of the counts of earlier ranges, one row for each group and range that it touches, make the
    numbers ranks. Rows that tie wholly are told apart by where they came from, so a value that a third of all
    rows have is cut into ranges like any other; the order of such rows is any. A null group is a group, and nulls come
    first in an ascending order. No rows give no rows.
    """
    have, end = {c.lower() for c in df.columns}, ""
    names = ("_tie", "_at", "_range", "_first", "_before", "_r", *[f"_g{i}" for i in range(len(by))])
    while any(f"{c}{end}" in have for c in names):
        end += "_"
    tie, at, inside, first, before, r, *groups = (f"{c}{end}" for c in names)
    made = checkpointed(df.withColumn(tie, F.monotonically_increasing_id()))
    ranges = max(1, math.ceil(made.count() / range_rows))
    keys = [*[F.asc(c) for c in by], *[F.desc(c) if c in descending else F.asc(c) for c in order], F.asc(tie)]
    laid = checkpointed(made.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).drop(tie).withColumn(at, F.monotonically_increasing_id()))
    laid = laid.withColumn(inside, F.shiftright(at, PLACE_BITS))
    earlier = W.partitionBy(*(by or [F.lit(1)])).orderBy(inside).rowsBetween(W.unboundedPreceding, -1)
    sizes = laid.groupBy(*by, inside).agg(F.min(at).alias(first), F.count("*").alias("n"))
    sizes = sizes.select(*[F.col(c).alias(g) for c, g in zip(by, groups)], F.col(inside).alias(r), first, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before))
    same = F.col(inside) == F.col(r)
    for c, g in zip(by, groups):
        same &= F.col(c).eqNullSafe(F.col(g))
    return laid.join(sizes, same).withColumn(name, F.col(before) + F.col(at) - F.col(first) + 1).select(*df.columns, name)
