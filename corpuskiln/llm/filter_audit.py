"""Filter interaction audit: five filters, all their orders, and what each removes, repeats or loses.

1. Texts are scanned in the buffers that Arrow holds them in. Byte classes and prefix sums count words, capitals, symbols and
   code points of all texts of a batch at once. Word hashes, sorted within their text, give the distinct words; neighbours
   with equal hashes are compared byte by byte, and a text with two words of one hash is counted over.
2. A document becomes a mask of the filters that it fails. Copies are rows with a smaller id of the same 128-bit digest:
   the smallest id of each digest is found with map-side combination, so a text that makes up a third of all rows is no
   large group, and what passes is subtracted from all.
3. Masks reduce everything: a part has 32 counts, whatever its rows, and each of the 600 places in the 120 orders is a sum over them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from hashlib import blake2b
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .buffers import class_table, counts_in, text_buffer, words_in
from .common import bytes_of, checkpointed, small_batches, table, text_chunks
from .tokens import WHITE, hash_runs

FILTERS = "ABCDE"
#: Words under this number, distinct words under this percentage, capitals over this percentage of the code points.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
SYMBOLS = b"#$%&*|"
_WORD, _CAPITAL, _SYMBOL = ~WHITE, class_table(bytes(range(0x41, 0x5B))), class_table(SYMBOLS)
#: Every byte of UTF-8 that begins a code point.
_POINT = ~class_table(bytes(range(0x80, 0xC0)))
#: Bytes of words that are hashed or compared at once; a longer word is hashed alone.
PIECE = 2 << 20


def _blocks(size: np.ndarray) -> Iterator[slice]:
    """Slices of neighbours whose sizes sum to about PIECE."""
    group = np.cumsum(size) // PIECE
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), len(size)]
    return (slice(a, b) for a, b in zip(cuts, cuts[1:]) if b > a)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    out, size = np.zeros(len(start), np.uint64), end - start
    long = size > PIECE
    for i in np.flatnonzero(long):
        out[i] = int.from_bytes(blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    short = np.flatnonzero(~long)
    for block in _blocks(size[short]):
        at = short[block]
        out[at] = hash_runs(data, start[at], end[at])
    return out


def _same(data: np.ndarray, start: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether words a[i] and b[i] are equal, byte by byte."""
    same = size[a] == size[b]
    pairs = np.flatnonzero(same)
    for block in _blocks(size[a[pairs]]):
        at = pairs[block]
        n = size[a[at]]
        before = np.cumsum(n) - n
        inside = np.arange(n.sum()) - np.repeat(before, n)
        equal = data[np.repeat(start[a[at]], n) + inside] == data[np.repeat(start[b[at]], n) + inside]
        same[at] = np.logical_and.reduceat(equal, before)
    return same


def distinct_words(data: np.ndarray, edge: np.ndarray, start: np.ndarray, end: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How many different words each text has, from sorted hashes that are verified on the words."""
    if not len(start):
        return np.zeros(len(counts), np.int64)
    text, h = np.repeat(np.arange(len(counts)), counts), word_hashes(data, start, end)
    order = np.lexsort((h, text))
    a, b = order[:-1], order[1:]
    again = np.flatnonzero((h[a] == h[b]) & (text[a] == text[b]))
    a, b = a[again], b[again]
    out = counts - np.bincount(text[b], minlength=len(counts))
    for i in np.unique(text[b][~_same(data, start, end - start, a, b)]):
        out[i] = len(set(data[edge[i] : edge[i + 1]].tobytes().split()))
    return out


def masks_of(column: pa.Array) -> np.ndarray:
    """Of each text, the bits of the filters A to D that it fails."""
    data, edge = text_buffer(column)
    start, end, words = words_in(data, edge, _WORD)
    distinct = distinct_words(data, edge, start, end, words)
    points, capitals, symbols = (counts_in(data, edge, x) for x in (_POINT, _CAPITAL, _SYMBOL))
    failing = (words < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * words, 100 * capitals > MOST_CAPITALS * points, symbols > 0)
    return sum(f.astype(np.int32) << k for k, f in enumerate(failing))


def _scanned(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask (A to D), and the text's digest as two numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            digests = np.frombuffer(b"".join(blake2b(x, digest_size=16).digest() for x in bytes_of(batch)), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(masks_of(batch.column("text"))), pa.array(digests[:, 0]), pa.array(digests[:, 1])], names=["doc_id", "part", "mask", "x", "y"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), "text")
    return small_batches(rows).mapInArrow(run, "doc_id long, part string, mask int, x long, y long")


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts of documents by part, mask (bits of A to E), good and toxic.

    Rows equal in id, part and text are counted together before anything is joined. Labels of an id are merged: good if any row
    says quality 1, toxic if any says toxic 1. A row without id has no label and is no copy of another.
    """
    rows = _scanned(docs).groupBy("doc_id", "part", "mask", "x", "y").agg(F.count("*").alias("n"))
    marks = labels.select(F.col("doc_id").cast("long").alias("i"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")).where("i IS NOT NULL AND (good OR toxic)")
    marks = marks.groupBy("i").agg(F.coalesce(F.max("good"), F.lit(False)).alias("good"), F.coalesce(F.max("toxic"), F.lit(False)).alias("toxic"))
    # Rows without id are dealt by their digest, since a null key would bring all of them together.
    absent = F.col("doc_id").isNull()
    own = rows.withColumn("a", absent).withColumn("k", F.when(absent, F.col("x")).otherwise(F.col("doc_id")))
    joined = own.join(marks.withColumn("b", F.lit(False)), (F.col("k") == F.col("i")) & (F.col("a") == F.col("b")), "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    joined = checkpointed(joined.select("doc_id", "part", "mask", "x", "y", "n", flag("good"), flag("toxic")))
    cell = ["part", "mask", "good", "toxic"]
    every = joined.groupBy(*cell).agg(F.sum("n").alias("n"), F.lit(0).cast("long").alias("first"))
    # One id may have several parts; the list has an entry for each.
    kept = joined.where(~absent).groupBy("x", "y", "doc_id").agg(F.collect_list(F.struct(*cell, "n")).alias("rows"))
    kept = kept.groupBy("x", "y").agg(F.min_by("rows", "doc_id").alias("rows")).select(F.inline("rows")).unionByName(joined.where(absent).select(*cell, "n"))
    kept = kept.groupBy(*cell).agg(F.lit(0).cast("long").alias("n"), F.sum("n").alias("first"))
    both = every.unionByName(kept).groupBy(*cell).agg(F.sum("n").alias("n"), F.sum("first").alias("first"))
    split = F.inline(F.array(F.struct(F.col("mask"), F.col("first").alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(16)).alias("mask"), (F.col("n") - F.col("first")).alias("n"))))
    return both.select("part", "good", "toxic", split).where("n > 0").select("part", "mask", "good", "toxic", "n")


def _places() -> list[dict]:
    """Each place in each order: its filter's bit, and the bits of the filters before it."""
    bit = {x: 1 << k for k, x in enumerate(FILTERS)}
    return [{"filter_order": "".join(p), "step": k + 1, "bit": bit[x], "before": sum(bit[y] for y in p[:k])} for p in permutations(FILTERS) for k, x in enumerate(p)]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    docs has doc_id, text and source, labels has doc_id, quality and toxic. A part is a source; null and "" are one. A null text
    counts as empty: it fails A and, if a smaller id has an empty text, E. Rows with equal id and text don't make each other
    copies. Parts without documents, and an empty table, give no rows.
    """
    # At most 32 masks with or without each label: a list of 128 counts per part.
    parts = masks(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "good", "toxic", "n")).alias("counts"))
    places = F.from_json(F.lit(json.dumps(_places())), "array<struct<filter_order: string, step: int, bit: int, before: int>>")
    rows = parts.select("part", "counts", F.inline(places))

    def total(which: str, weight: str = "1") -> Column:
        return F.expr(f"aggregate(counts, 0L, (t, c) -> t + IF({which}, c.n * {weight}, 0L))")

    fails, earlier = "(c.mask & bit) <> 0", "(c.mask & before) <> 0"
    # Of the orders, a k-th have a failed filter before the other k - 1 that fail too.
    shapley = f"({factorial(len(FILTERS))}L div bit_count(c.mask))"
    return rows.select(
        "part", "filter_order", "step", total("(c.mask & (bit | before)) = 0").alias("kept"), total(f"{fails} AND NOT {earlier}").alias("removed"), total(f"{fails} AND {earlier}").alias("redundant"),
        total("c.mask = bit").alias("unique_fails"), total(f"c.good AND {fails} AND NOT {earlier}").alias("good_lost"), total(f"c.toxic AND {fails} AND NOT {earlier}").alias("toxic_lost"), total(fails, shapley).alias("shapley"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents", "doc_id", "text", "source"), table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


SQL = r"""
WITH l AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), d AS (
  SELECT d.doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM documents d LEFT JOIN l ON d.doc_id = l.doc_id
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS smallest FROM d
), m AS (
  SELECT part, good, toxic, CAST(len(w) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT)
    + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS INT) + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT)
    + 16 * CAST(coalesce(doc_id > smallest, false) AS INT) AS mask FROM w
), c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE toxic) AS x FROM m GROUP BY ALL
), f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS b
), o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM f a, f b, f c, f d, f e WHERE a.b + b.b + c.b + d.b + e.b = 31
    AND len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), p AS (SELECT filter_order, CAST(step AS INT) AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0) AS before FROM o, range(1, 6) s(step)
), r AS (
  SELECT part, filter_order, step, bit, sum(n) FILTER (WHERE (mask & CAST(bit + before AS INT)) = 0) AS kept, sum(n) FILTER (WHERE (mask & bit) <> 0 AND (mask & CAST(before AS INT)) = 0) AS removed,
    sum(n) FILTER (WHERE (mask & bit) <> 0 AND (mask & CAST(before AS INT)) <> 0) AS redundant, sum(n) FILTER (WHERE mask = bit) AS unique_fails,
    sum(g) FILTER (WHERE (mask & bit) <> 0 AND (mask & CAST(before AS INT)) = 0) AS good_lost, sum(x) FILTER (WHERE (mask & bit) <> 0 AND (mask & CAST(before AS INT)) = 0) AS toxic_lost
  FROM c, p GROUP BY ALL
), s AS (SELECT part, bit, sum(removed) AS shapley FROM r GROUP BY ALL)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(coalesce(shapley, 0) AS BIGINT) AS shapley
FROM r JOIN s USING (part, bit)
"""
