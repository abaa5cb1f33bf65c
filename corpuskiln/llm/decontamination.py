"""Benchmark decontamination: a broadcast hash set of benchmark n-grams against document windows.

Everything is DataFrame expressions. A window is ``n`` consecutive words of a benchmark item
(an item of fewer words is one window). The places of a document's windows are exploded and probe the broadcast set,
by the hash of a window's first, middle and last word, inside one code-generated stage; a probe that hits is verified by
comparing all the words there, so only true hits are ever shuffled. A row that marks the document itself goes along
and carries its number of words, so texts are cut into words once. The set is broadcast
in parts of at most ``MAX_WINDOWS`` windows, whatever the benchmark's size: a larger benchmark
means more passes over the documents, not a larger broadcast.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, lower_ascii, table

N = 13
#: Windows in one broadcast. A window is N words; at 20 bytes a word a part stays under 60 MB.
MAX_WINDOWS = 200_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of the text, A-Z in lower case; none for a null text."""
    return F.coalesce(F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def window_key(words: Column, first: Column, length: Column) -> Column:
    """A hash of three words of the window that starts at the 0-based ``first``."""
    return F.xxhash64(F.get(words, first), F.get(words, first + F.floor(length / 2).cast("int")), F.get(words, first + length - 1))


def benchmark_windows(benchmark: DataFrame, n: int = N) -> DataFrame:
    """One row per distinct window: key, length, words, items (ids as strings; null ids are left out)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("w"))
    length = F.least(F.size("w"), F.lit(n))
    made = F.when(length > 0, F.transform(F.sequence(F.lit(1), F.size("w") - length + 1), lambda i: F.slice("w", i, length)))
    # An outer explode: a filter on the array's size, which Catalyst adds to an inner one, would be
    # pushed below the projections and there compute the words again for every window.
    windows = items.select("item_id", length.alias("length"), F.explode_outer(made).alias("window")).where(F.col("window").isNotNull())
    return windows.groupBy("length", "window").agg(F.collect_set("item_id").alias("items")).withColumn("key", window_key(F.col("window"), F.lit(0), F.col("length")))


def hits(docs: DataFrame, windows: DataFrame, keys: list[str], max_windows: int = MAX_WINDOWS) -> DataFrame:
    """The ``keys`` columns of a document, n_words, and first word (from 1), length, items of a verified occurrence.

    docs has the ``keys`` and ``text``. Each document also gives a row without an occurrence.
    """
    stats = windows.groupBy().agg(F.count("*").alias("n"), F.sort_array(F.collect_set("length")).alias("lengths")).first()
    lengths: list[int] = list(stats["lengths"])
    parts = max(1, math.ceil(stats["n"] / max_windows))
    own = [F.col(k) for k in keys]
    words = docs.select(*own, words_of(F.col("text")).alias("_words"))
    size = F.size("_words")
    total = sum((F.greatest(size - x + 1, F.lit(0)) for x in lengths), F.lit(0))
    # Place 0 marks the document; the places of the lengths follow each other and tell the length and the first word.
    probes = words.select(*own, "_words", size.alias("_n"), F.explode(F.sequence(F.lit(0), total)).alias("_at"))
    length, first, before = F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(1)
    for x in lengths:
        count = F.greatest(F.col("_n") - x + 1, F.lit(0))
        inside = length.isNull() & (F.col("_at") >= 1) & (F.col("_at") < before + count)
        length, first, before = F.when(inside, F.lit(x)).otherwise(length), F.when(inside, F.col("_at") - before).otherwise(first), before + count
    if len(lengths) == 1:
        length, first = F.when(F.col("_at") >= 1, F.lit(lengths[0])), F.col("_at") - 1
    renamed = windows.select(F.col("key").alias("_b_key"), F.col("length").alias("_b_length"), F.col("window").alias("_b_window"), F.col("items").alias("_b_items"))
    placed = probes.select(*own, "_words", "_n", "_at", length.alias("_length"), first.alias("_first"))
    key = F.when(F.col("_at") >= 1, window_key(F.col("_words"), F.col("_first"), F.col("_length")))

    def part(k: int) -> DataFrame:
        side = F.broadcast(renamed.where(F.pmod("_b_key", F.lit(parts)) == k) if parts > 1 else renamed)
        same = (key == F.col("_b_key")) & (F.col("_length") == F.col("_b_length")) & (F.slice("_words", F.col("_first") + 1, F.col("_length")) == F.col("_b_window"))
        found = placed.join(side, same, "left")
        found = found.where(F.col("_b_key").isNotNull() | (F.col("_at") == 0) if k == 0 else F.col("_b_key").isNotNull())
        return found.select(*own, F.col("_n").alias("n_words"), F.when(F.col("_b_key").isNotNull(), F.col("_first") + 1).alias("first"), F.when(F.col("_b_key").isNotNull(), F.col("_length")).alias("length"), F.col("_b_items").alias("items"))

    return reduce(DataFrame.unionByName, [part(k) for k in range(parts)])


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = N, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """Per row of docs(doc_id, text): n_words, n_hit, item_ids (sorted), hit spans, contaminated.

    A document word inside any occurrence of a window is hit; a document is contaminated when at
    least a twentieth of its words are. A null text has no words; a null doc_id is kept; rows with
    equal doc_id and text share one result, each keeping its row; an empty benchmark hits nothing; an empty table gives
    an empty result. A text's words are one array in one task, whatever its length.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_text", F.xxhash64("text"))
    found = hits(rows, benchmark_windows(benchmark, n), ["doc_id", "_text"], max_windows)
    span = F.when(F.col("first").isNotNull(), F.struct("first", "length"))
    found = found.groupBy("doc_id", F.col("_text").alias("text_key")).agg(
        F.max("n_words").cast("long").alias("n_words"), F.count_if(F.col("first").isNull()).alias("_rows"),
        F.sort_array(F.collect_set(span)).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"),
    )
    # Words in spans: what each span adds beyond the ones before it.
    ends = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("hit"))
    covered = F.aggregate("spans", ends, lambda a, s: F.struct(F.greatest(a["end"], s["first"] + s["length"]).alias("end"), (a["hit"] + F.greatest(s["first"] + s["length"] - F.greatest(s["first"], a["end"]), F.lit(0))).alias("hit")), lambda a: a["hit"])
    found = found.withColumn("n_hit", covered).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    return found.select("doc_id", "text_key", "n_words", "n_hit", "item_ids", "spans", "contaminated", F.explode(F.sequence(F.lit(1), F.col("_rows"))).alias("_copy")).drop("_copy")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """The rows of docs, all columns, that are not contaminated. Null and empty texts stay."""
    id_name, text_name = free_name(docs, "_bad_id"), free_name(docs, "_bad_text")
    bad = contamination(docs, benchmark, n).where("contaminated").select(F.col("doc_id").alias(id_name), F.col("text_key").alias(text_name)).distinct()
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad[id_name]) & (F.xxhash64(docs["text"]) == bad[text_name]), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []::VARCHAR[]) AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), bl AS (SELECT item_id, w, least(len(w), 13) AS l FROM b WHERE len(w) > 0
), bw AS (
  SELECT DISTINCT item_id, l, array_to_string(w[i:i + l - 1], ' ') AS k FROM (SELECT item_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM bl)
), lens AS (SELECT DISTINCT l FROM bw
), dw AS (
  SELECT r, l, i, array_to_string(w[i:i + l - 1], ' ') AS k FROM (SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, lens WHERE len(w) >= l)
), h AS (SELECT dw.r, dw.i, dw.l, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.l = bw.l
), c AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + l)) AS p FROM (SELECT DISTINCT r, i, l FROM h)) GROUP BY r
), t AS (
  SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""
