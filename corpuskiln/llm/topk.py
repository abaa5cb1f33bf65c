"""Exact top-k search by inner product with multi-resolution segment statistics.

For vectors cut into segments, q.v <= sum over segments of n * (mean_q * mean_v + dev_q * dev_v), by
Cauchy and Schwarz; so |q|^2 + |v|^2 - 2 * that sum is a lower bound of the squared distance, the
higher the scores the smaller the distance. Bounds are taken coarse to fine, with 1, 4 and 16 segments and with three
quarters as many as components (``levels``); a pair whose bound cannot reach the query's k-th best score
so far is dropped, and exact scores are computed for the rest.

The k-th best is known from the start: every query first meets the ``SEEDS`` rows of lowest hashes, and the k-th best
score among some rows is at most that among all. Then queries and candidates are dealt to blocks of bounded size;
every block of queries meets every block of candidates in a task of its own, which returns the k best of each query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small_batches, table

QUERY_BLOCK, ROW_BLOCK = 1024, 8192
STEP = 1024
#: Rows that give each query its first threshold; a bound, whatever the table's size.
SEEDS = 4096
#: Share of surviving pairs under which pairs are gathered instead of whole blocks multiplied.
FEW = 1 / 8
#: Products of norms above which sums of doubles may be inexact.
EXACT = float(1 << 52)


def levels(dim: int) -> list[int]:
    """Numbers of segments, coarse to fine."""
    return sorted({min(s, dim) for s in (1, 4, 16, max(1, dim * 3 // 4))})


def statistics(vectors: np.ndarray, segments: int) -> np.ndarray:
    """A row of scaled means and deviations per vector, such that dot products of rows bound those of vectors."""
    out = []
    for part in np.array_split(np.arange(vectors.shape[1]), min(segments, vectors.shape[1])):
        own = vectors[:, part]
        scale = math.sqrt(len(part))
        out.append(own.mean(1) * scale)
        if len(part) > 1:
            out.append(own.std(1) * scale)
    return np.stack(out, 1)


def _norms(x: np.ndarray) -> float:
    return float(np.sqrt((x * x).sum(1).max(initial=0)))


def _scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two arrays of whole numbers, row by row; beyond 64 bits the nearest long."""
    if _norms(queries) * _norms(rows) < EXACT:
        return np.einsum("ij,ij->i", queries, rows).astype(np.int64)
    exact = [sum(int(x) * int(y) for x, y in zip(a, b)) for a, b in zip(queries, rows)]
    return np.array([min(max(x, -(1 << 63)), (1 << 63) - 1) for x in exact], np.int64)


def best_pairs(query_ids: np.ndarray, queries: np.ndarray, row_ids: np.ndarray, rows: np.ndarray, k: int, least: np.ndarray | None = None, compared: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of query, id of row, score) of each query's k highest scores, ties to the smaller id; own ids are left out.

    least: scores that each query's k-th best is known to reach; lower ones may be left out. compared: gets the
    number of pairs and of those whose exact score was computed.
    """
    order = np.argsort(-(rows * rows).sum(1), kind="stable")
    row_ids, rows = row_ids[order], rows[order]
    by_level = [(statistics(queries, s), statistics(rows, s)) for s in levels(rows.shape[1])]
    least = np.full(len(queries), -np.inf) if least is None else least.astype(np.float64).copy()
    # Scores are whole numbers, so half a unit covers the rounding of the bounds; more is allowed for large ones.
    slack = 0.5 + 1e-9 * _norms(queries) * _norms(rows)
    found = [np.zeros(0, np.int64) for _ in range(3)]
    for at in range(0, len(rows), STEP):
        part = slice(at, at + STEP)
        floor = (least - slack)[:, None]
        open_ = query_ids[:, None] != row_ids[None, part]
        pairs = None
        for own_q, own_r in by_level:
            if pairs is None and open_.mean() >= FEW:
                open_ &= own_q @ own_r[part].T >= floor
                continue
            q, r = pairs if pairs is not None else np.nonzero(open_)
            keep = np.einsum("ij,ij->i", own_q[q], own_r[r + at]) >= floor[q, 0]
            pairs = q[keep], r[keep]
        q, r = pairs if pairs is not None else np.nonzero(open_)
        r = r + at
        if compared is not None:
            compared.append((len(queries) * len(row_ids[part]), len(q)))
        score = np.concatenate([_scores(queries[q[i : i + STEP * 64]], rows[r[i : i + STEP * 64]]) for i in range(0, len(q), STEP * 64)] or [np.zeros(0, np.int64)])
        keep = score >= least[q]
        q, ids, score = (np.concatenate([a, b]) for a, b in zip(found, (q[keep], row_ids[r[keep]], score[keep])))
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        found = [x[rank < k] for x in (q, ids, score)]
        full = rank == k - 1
        least[q[full]] = np.maximum(least[q[full]], score[full])
    return found[0], found[1], found[2]


def _by_dimension(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which rows, their vectors) for each dimension that occurs."""
    sizes = np.asarray(vectors.value_lengths())
    for d in np.unique(sizes):
        yield np.flatnonzero(sizes == d), np.asarray(vectors.filter(pa.array(sizes == d)).flatten()).reshape(-1, d)


def _with_thresholds(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """The queries with ``least``: the k-th best score among the seed rows; null where these are too few."""
    seeds = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(SEEDS).toArrow()
    ids = np.asarray(seeds.column("vec_id"))
    by_size = {v.shape[1]: (ids[at], v) for at, v in _by_dimension(seeds.column("v").combine_chunks())} if len(ids) else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = np.full(batch.num_rows, np.nan)
            own = np.asarray(batch.column("vec_id"))
            for at, v in _by_dimension(batch.column("v")):
                if v.shape[1] in by_size:
                    row_ids, seed = by_size[v.shape[1]]
                    q, _, score = best_pairs(own[at], v, row_ids, seed, k)
                    last = np.flatnonzero(np.bincount(q, minlength=len(at)) == k)
                    least[at[last]] = score[np.searchsorted(q, last, "right") - 1]
            yield batch.append_column("least", pa.array(least, from_pandas=True))

    return small_batches(queries.select("vec_id", "v")).mapInArrow(run, "vec_id long, v array<double>, least double")


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of vectors(vec_id, embedding) for which is_query holds.

    Components become floor(scale * x). Vectors that are null, empty or hold a null or non-finite
    component, and rows without a vec_id, take no part; only vectors of the query's dimension are
    candidates. Rows with the query's vec_id are its own. Repeated query rows count once, repeated
    candidates each; a vec_id with several vectors is a query with each of them, ranked on its own.
    Scores are exact; one that does not fit 64 bits becomes the nearest long. An empty table gives an empty result.
    """
    x = F.col("embedding")
    sound = F.col("vec_id").isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    scaled = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("double"))
    rows = vectors.where(F.coalesce(sound, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("v"))
    queries = rows.where(is_query).distinct()
    sizes = rows.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).first()
    query_blocks, row_blocks = max(1, math.ceil(sizes["q"] / query_block)), max(1, math.ceil(sizes["n"] / row_block))

    def dealt(df: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        block = F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int")
        return df.select("*", block.alias(own), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        ids, key, least = (np.asarray(left.column(c)) for c in ("vec_id", "key", "least"))
        row_ids = np.asarray(right.column("vec_id"))
        there = {v.shape[1]: (row_ids[at], v) for at, v in _by_dimension(right.column("v").combine_chunks())} if right.num_rows else {}
        for at, v in _by_dimension(left.column("v").combine_chunks()) if left.num_rows else ():
            if v.shape[1] in there:
                own = least[at].astype(np.float64)
                a, found, score = best_pairs(ids[at], v, *there[v.shape[1]], k, np.where(np.isnan(own), -np.inf, own))
                out.append(pa.table({"query_id": ids[at][a], "key": key[at][a], "vec_id": found, "score": score}))
        schema = pa.schema([(c, pa.int64()) for c in ("query_id", "key", "vec_id", "score")])
        return pa.concat_tables(out) if out else schema.empty_table()

    cells = ["q_block", "r_block"]
    spread = queries.repartition(4 * query_blocks, "vec_id", "v")
    q = dealt(_with_thresholds(spread, rows, k), "q_block", query_blocks, "r_block", row_blocks).withColumn("key", F.xxhash64("v"))
    r = dealt(rows, "r_block", row_blocks, "q_block", query_blocks)
    found = q.groupBy(*cells).cogroup(r.groupBy(*cells)).applyInArrow(search, "query_id long, key long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.pmod(F.col("vec_id"), F.lit(20)) == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
