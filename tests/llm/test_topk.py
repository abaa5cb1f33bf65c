import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuskiln.llm import topk


@settings(deadline=None, max_examples=40)
@given(st.integers(0, 10_000), st.integers(1, 70), st.integers(1, 30))
def test_bounds_hold(seed, dim, segments):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(-60, 60, (5, dim)).astype(float), rng.integers(-60, 60, (7, dim)).astype(float)
    assert (topk.statistics(a, segments) @ topk.statistics(b, segments).T >= a @ b.T - 1e-6).all()


def brute(rows, k, scale=64):
    sound = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out, seen = [], set()
    for i, q in sound:
        if i % 5 or (i, tuple(q)) in seen:
            continue
        seen.add((i, tuple(q)))
        found = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in sound if j != i and len(v) == len(q))
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found[:k])]
    return sorted(out)


def test_edges(spark):
    rng = random.Random(4)
    rows = [(i, [float(np.float32(rng.uniform(-1, 1))) for _ in range(6)]) for i in range(90)]
    rows += [(i, list(rows[3][1])) for i in range(100, 120)] + [(5, list(rows[5][1])), (130, [1.0, 2.0]), (135, [2.0, 1.0])]
    rows += [(140, None), (145, []), (150, [None] * 6), (155, [float("nan")] * 6), (160, [float("inf")] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, v string, score string")
    for blocks in ((1024, 8192), (4, 7)):
        got = sorted(tuple(r) for r in topk.top_k(df, F.pmod("vec_id", F.lit(5)) == 0, 7, query_block=blocks[0], row_block=blocks[1]).collect())
        assert got == brute(rows, 7)
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0


def test_query_equals_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert sorted(tuple(r) for r in topk.query(spark, sf).collect()) == sorted(con.sql(topk.SQL).fetchall())


def test_bounds_prune_the_embeddings():
    """Of the pairs of queries and rows, few get an exact score; the rows alone decide, so SQL's answer stays."""
    import os

    import pyarrow.parquet as pq

    t = pq.read_table(os.environ.get("TESTDATA_DIR", "/root/testdata") + "/sf0.1/embeddings.parquet", columns=["vec_id", "embedding"]).to_pydict()
    sound = [(i, v) for i, v in zip(t["vec_id"], t["embedding"]) if v and None not in v]
    ids, v = np.array([i for i, _ in sound]), np.floor(64 * np.array([x for _, x in sound], np.float64))
    own = ids % 20 == 0
    compared: list = []
    first = topk.best_pairs(ids[own], v[own], ids, v, 20)
    least = np.array([first[2][first[0] == i].min() for i in range(own.sum())], float)
    again = topk.best_pairs(ids[own], v[own], ids, v, 20, least, compared)
    assert all((a == b).all() for a, b in zip(first, again))
    pairs, exact = np.array(compared).sum(0)
    print(f"exact scores for {exact / pairs:.3f} of the pairs")
    assert exact < 0.2 * pairs


def test_large_components_stay_exact():
    ids = np.arange(6)
    v = np.array([[2.0**31 + i, 2.0**30 - i, 1.0] for i in range(6)])
    q, found, score = topk.best_pairs(ids[:1], v[:1], ids, v, 3)
    want = sorted((-sum(int(a) * int(b) for a, b in zip(v[0], v[j])), j) for j in range(1, 6))[:3]
    assert [(-s, j) for s, j in zip(score.tolist(), found.tolist())] == want
