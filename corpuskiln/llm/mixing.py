"""Mixing sources to target weights: sizes per source, repetition rates, and documents repeated by them.

1. Words are summed per source.
2. Sources share ``share`` of all words by weight; no source gives more than ``cap`` times its words, and what it
   can't give is shared again among the others, until none is above.
3. A source's rate is its target over its words. A document is taken floor(rate) times, and once more if its draw,
   a hash of seed, id and text, lies below the rate's fraction.

All is DataFrame expressions. Rates reach the documents by a broadcast where the sources are few enough (checked), else the
sources of many documents, of which there can't be many, are broadcast and the others joined by a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import ranked
from .common import checkpointed, free_name, table

WEIGHTS, SHARE, CAP = (5.0, 2.0, 1.0), 1.5, 2.0
SEED = 2024
#: Sources, and bytes of their names, that may be broadcast.
MOST_SOURCES, MOST_BYTES = 10_000, 8 << 20
#: A source with a larger part of the documents than one in so many is broadcast on its own.
HOT_PART = 1_000
SPACE = " \t\n\x0b\f\r"


def size_of(text: Column) -> Column:
    """The number of runs of characters that are not white space; 0 for null. Each run becomes a letter, no array is made."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++", "w")
    return F.length(F.translate(marks, SPACE, "")).cast("long")


def draw_of(doc_id: Column, text: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) from a hash of seed, id and text; null counts as empty. Rows equal in both draw alike."""
    blank = F.lit("")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), blank), F.lit(":"), F.coalesce(text, blank)), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def source_rates(sizes: DataFrame, source: str = "source", size: str = "size", weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """A row per source: source, rows, source_size, target, rate (0 for a source without words).

    Sources in the order of their code points, null last, have the weights in turn. The loop brings two numbers per
    round to the driver, whatever the number of sources: the words that full sources give and the weight of the others.
    """
    if not 0 <= share <= cap:
        raise ValueError("sources can't give more than cap times their words")
    totals = sizes.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("rows"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("source_size"))
    placed = ranked(totals.withColumn("absent", F.col("source").isNull()), ["absent", "source"], name="place")
    turn = F.pmod(F.col("place") - 1, F.lit(len(weights)))
    weight = F.coalesce(*[F.when(turn == k, F.lit(float(w))) for k, w in enumerate(weights)])
    sources = checkpointed(placed.select("source", "rows", "source_size", weight.alias("weight")))
    full_at = F.col("source_size") * cap
    total = (sources.agg(F.sum("source_size")).first()[0] or 0) * share
    level, full = 0.0, -1
    while True:
        above = F.col("weight") * level > full_at
        r = sources.agg(F.coalesce(F.sum(F.when(above, full_at)), F.lit(0.0)).alias("given"), F.sum(F.when(~above, F.col("weight"))).alias("open"), F.count_if(above).alias("full")).first()
        # The level only rises, so full sources stay full; it rests when no more become so.
        if r["full"] == full or not r["open"]:
            break
        full, level = r["full"], (total - r["given"]) / r["open"]
    target = F.least(full_at, F.col("weight") * level)
    return sources.select("source", "rows", "source_size", target.alias("target"), F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate"))


def with_rates(docs: DataFrame, rates: DataFrame, source: str = "source", most: int = MOST_SOURCES) -> DataFrame:
    """docs with source_size, target and rate of their source; columns of docs with such names are replaced."""
    docs = docs.drop("source_size", "target", "rate")
    key = free_name(docs, "_source")
    rates = rates.withColumnRenamed("source", key)
    facts = rates.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(key)), F.lit(0)).alias("bytes"), F.sum("rows").alias("rows")).first()
    same = F.col(source).eqNullSafe(F.col(key))
    own = [*docs.columns, "source_size", "target", "rate"]
    if facts["n"] <= most and facts["bytes"] <= MOST_BYTES:
        return docs.join(F.broadcast(rates), same).select(*own)
    # At most HOT_PART sources have more than one in HOT_PART of all rows; the name of a source is no longer than a row.
    hot = rates.where(F.col("rows") > (facts["rows"] or 0) / HOT_PART)
    marked = docs.join(F.broadcast(hot), same, "left")
    done = marked.where(F.col("rate").isNotNull()).select(*own)
    rest = docs.join(F.broadcast(hot.select(key)), same, "left_anti").join(rates.where(F.col("rows") <= (facts["rows"] or 0) / HOT_PART).hint("merge"), same)
    return done.unionByName(rest.select(*own))


def copies_of(rate: Column, draw: Column) -> Column:
    """floor(rate), and one more if the draw is below the fraction."""
    whole = F.floor(rate)
    return whole + F.when(draw < rate - whole, 1).otherwise(0)


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED, name: str = "copy") -> DataFrame:
    """The rows of docs(doc_id, text, source), all columns, each as often as the mix takes it, numbered from 1 in ``name``.

    Null and empty texts have no words; a null source is a source, the last; null ids draw by their text. Rows with equal id
    and text draw alike, so they are taken equally often. Sources without words, and empty tables, give nothing. The same
    rows give the same mix, in whatever order or partitions they come.
    """
    rates = source_rates(docs.select("source", size_of(F.col("text")).alias("size")), weights=weights, share=share, cap=cap)
    key = free_name(docs, "_rate")
    rated = with_rates(docs.select(F.struct(*docs.columns).alias("row"), F.col("source"), F.col("doc_id").alias("i"), F.col("text").alias("x")), rates)
    taken = rated.withColumn(key, copies_of(F.col("rate"), draw_of(F.col("i"), F.col("x"), seed))).where(F.col(key) > 0)
    return taken.select("row.*", F.explode(F.sequence(F.lit(1), F.col(key).cast("int"))).alias(name))


def plan(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """Per row of docs(doc_id, text, source): doc_id, source, size, source_size, target, rate, copies, taken (words).

    What ``mix`` does with each document, the texts being read once; see there for nulls, ties and empty tables.
    """
    rows = checkpointed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size_of(F.col("text")).alias("size"), draw_of(F.col("doc_id").cast("long"), F.col("text"), seed).alias("draw")))
    rated = with_rates(rows, source_rates(rows, weights=weights, share=share, cap=cap))
    rated = rated.withColumn("copies", copies_of(F.col("rate"), F.col("draw")))
    return rated.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(table(spark, sf_dir, "documents", "doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 13) AS BIGINT) / 4503599627370496.0 AS draw FROM documents
), g AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS s FROM d GROUP BY source
), w AS (
  SELECT source, s, CASE (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight FROM g
), o AS (
  SELECT *, coalesce(sum(2.0 * s) OVER before, 0) AS given, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS open, 1.5 * sum(s) OVER () AS total
  FROM w WINDOW before AS (ORDER BY s / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT (total - given) / open AS level FROM o WHERE (total - given) / open * weight <= 2.0 * s ORDER BY s / weight, source NULLS LAST LIMIT 1
), t AS (
  SELECT source, s, CAST(least(2.0 * s, weight * coalesce((SELECT level FROM l), 0)) AS DOUBLE) AS target FROM w
), r AS (
  SELECT doc_id, size, s, target, draw, CASE WHEN s > 0 THEN target / s ELSE 0 END AS rate FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, s AS source_size, target, CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""
