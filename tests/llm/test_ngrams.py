import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuskiln.llm import eliasfano, ngrams
from corpuskiln.llm.eliasfano import EliasFano

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 2**40), max_size=200), st.lists(st.integers(0, 2**40), min_size=1, max_size=20))
def test_elias_fano(values, queries):
    v = np.sort(np.array(values, np.int64))
    e = EliasFano.code(v)
    if len(v):
        assert (e.access(np.arange(len(v))) == v).all()
    q = np.array(queries, np.int64)
    assert (e.successor(q, np.zeros(len(q), np.int64), np.full(len(q), len(v))) == np.searchsorted(v, q)).all()


def test_files_are_mapped(tmp_path):
    v = np.array([0, 0, 5, 9], np.int64)
    eliasfano.write(str(tmp_path / "x"), EliasFano.code(v).arrays())
    assert (EliasFano.of(eliasfano.mapped(str(tmp_path / "x"))).access(np.arange(4)) == v).all()


def brute(rows, order):
    tokens = [WORD.findall((t or "").encode().lower()) + [None] for _, t, _ in rows]
    counts = [Counter() for _ in range(order + 1)]
    for w, (_, _, held) in zip(tokens, rows):
        if not held:
            for m in range(1, order + 1):
                counts[m].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    followers = Counter(g[:-1] for c in counts[2:] for g in c)
    total, v = sum(counts[1].values()), len(counts[1])
    uni = lambda w: (counts[1][w,] + 0.5) / (total + 0.5 * (v + 1))
    out = []
    for w, (i, _, held) in zip(tokens, rows):
        score = 0.0
        for at, x in enumerate(w):
            p = uni(x)
            for m in range(2, min(order, at + 1) + 1):
                context = tuple(w[at - m + 1 : at])
                if n := counts[m - 1][context]:
                    p = max(counts[m][*context, x] - ngrams.DISCOUNT, 0) / n + ngrams.DISCOUNT * followers[context] / n * p
            score += math.log10(p)
        out.append((i, held, len(w), sum(counts[1][x,] > 0 for x in w), sum(math.log10(uni(x)) for x in w), score))
    return out, total


def same(a, b):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[4], 3))
    for x, y in zip(sorted(a, key=key), sorted(b, key=key), strict=True):
        assert x[:4] == y[:4]
        assert x[4] == pytest.approx(y[4], abs=1e-8) and x[5] == pytest.approx(y[5], abs=2e-4 * y[2])


@pytest.mark.parametrize(("order", "shard_words", "block"), [(2, 1 << 17, 1 << 21), (4, 1 << 17, 1 << 21), (2, 4, 7), (4, 4, 50), (1, 4, 7)])
def test_scores_match_brute_force(edge, edge_rows, monkeypatch, order, shard_words, block):
    monkeypatch.setattr(ngrams, "SHARD_WORDS", shard_words)
    monkeypatch.setattr(ngrams, "BLOCK", block)
    docs = edge.select("doc_id", "text", "key").withColumn("held_out", ngrams.is_held_out(F.col("doc_id")))
    model = ngrams.train(docs.where("NOT held_out"), order)
    got = [tuple(r) for r in ngrams.score(docs, model).collect()]
    held = {r.doc_id: r.held_out for r in docs.collect()}
    want, total = brute([(r[0], r[1], held[r[0]]) for r in edge_rows], order)
    assert model.total == total and model.order == order
    same(got, want)


def test_a_frequent_context_lies_in_many_shards(spark, monkeypatch):
    monkeypatch.setattr(ngrams, "BLOCK", 300)
    rows = [(i, " ".join(f"the w{i}x{k}" for k in range(40))) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", F.lit(False))
    model = ngrams.train(docs)
    assert np.diff(model.levels[1].rows).max() <= 330 and model.levels[1].rows[-1] == 2 * 2000
    same([tuple(r) for r in ngrams.score(docs, model).collect()], brute([(*r, False) for r in rows], 2)[0])


def test_without_training_rows(edge, empty):
    model = ngrams.train(empty)
    got = ngrams.score(edge.withColumn("held_out", F.lit(True)), model).collect()
    assert model.total == 0 and len(got) == edge.count() and all(r.n_known == 0 and r.base_score == r.score == 0 for r in got)
    assert ngrams.score(empty.withColumn("held_out", F.lit(True)), model).count() == 0


def test_folder_must_be_local():
    assert ngrams._local("file:///a/b") == "/a/b" and ngrams._local("/a") == "/a"
    with pytest.raises(ValueError):
        ngrams._local("hdfs://x/a")


def test_held_out_texts_are_likelier_than_under_unigrams(spark, sf):
    got = ngrams.query(spark, sf.replace("sf0.001", "sf0.01")).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert got.s > got.b
