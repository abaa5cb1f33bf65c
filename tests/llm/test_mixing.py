import re
from collections import Counter, defaultdict
from hashlib import sha256

import duckdb
import pytest
from pyspark.sql import functions as F

from corpuskiln.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, rate string, target string, _source string, row string, copy string"


def shares(sizes, weights=mixing.WEIGHTS, share=mixing.SHARE, cap=mixing.CAP):
    """Targets one round after the other, by sharing what is left among the open sources."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if weight[s] * level > cap * sizes[s]}
        if not above:
            return target | {s: weight[s] * level for s in open_}
        for s in above:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= above
    return target


def brute(rows):
    size = lambda t: len(WORD.findall(t or ""))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    target = shares(sizes)
    out = []
    for i, t, s in rows:
        draw = int(sha256(f"2024:{'' if i is None else i}:{t or ''}".encode()).hexdigest()[:13], 16) / 2**52
        rate = target[s] / sizes[s] if sizes[s] else 0.0
        out.append((i, size(t), sizes[s], round(target[s], 6), size(t) * (int(rate) + (draw < rate - int(rate)))))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows(edge_rows):
    made = [(r[0], r[1], ("b", None, "a", "", "é", "Z", "a", "a")[k % 8]) for k, r in enumerate(edge_rows)]
    return made + made[:2] + [(900 + k, "w " * (k % 40), "a") for k in range(120)] + [(None, f"text {k}", "blank") for k in range(20)] + [(2000, " \n", "no words")]


def plain(df):
    return sorted(((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in df.collect()), key=repr)


def test_plan_by_brute_force(spark, rows, empty):
    docs = spark.createDataFrame([(*r, *"xyzuv") for r in rows], SCHEMA)
    assert plain(mixing.plan(docs)) == brute(rows) == plain(mixing.plan(docs.repartition(7)))
    assert mixing.plan(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_many_sources_need_no_broadcast(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", mixing.size_of(F.col("text")))
    rates = mixing.source_rates(docs)
    key = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    assert key(mixing.with_rates(docs, rates, most=2)) == key(mixing.with_rates(docs, rates)) and len(key(mixing.with_rates(docs, rates))) == len(rows)


def test_copies_are_emitted(spark, rows):
    docs = spark.createDataFrame([(*r, *"xyzuv") for r in rows], SCHEMA)
    out = mixing.mix(docs, name="nth")
    assert out.columns == [*docs.columns, "nth"]
    got = Counter((r.doc_id, r.text, r.source) for r in out.collect())
    want = Counter()
    for r in mixing.plan(docs).join(docs.select("doc_id", "text"), "doc_id").distinct().collect():
        want[(r.doc_id, r.text, r.source)] = r.copies
    many = Counter(rows)
    assert all(got[k] == want[k] * many[k] for k in want if k[0] is not None and many[k] == 1) and max(got.values()) <= 2 * max(many.values())


def test_sources_come_near_their_targets(spark, sf):
    by = defaultdict(lambda: [0, 0.0, 0.0])
    for r in mixing.plan(spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.1')}/documents.parquet")).collect():
        f = r.rate % 1
        by[r.source][0] += r.taken
        by[r.source][1] = r.target
        by[r.source][2] += r["size"] ** 2 * f * (1 - f)
        assert r.taken <= 2 * r["size"]
    assert all(abs(taken - target) <= 5 * spread**0.5 for taken, target, spread in by.values())
    assert abs(sum(x[0] for x in by.values()) / sum(x[1] for x in by.values()) - 1) < 0.02


def test_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = mixing.query(spark, sf)
    want = con.sql(mixing.SQL)
    assert got.columns == want.columns and sorted(tuple(r) for r in got.collect()) == sorted(want.fetchall())


def test_parameters():
    with pytest.raises(ValueError):
        mixing.source_rates(None, share=3.0)
