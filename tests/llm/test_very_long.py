"""Texts of millions of bytes, with and without white space, through every operator that is not tested with such elsewhere."""

import random

import pytest
from pyspark.sql import functions as F

from corpuskiln.llm import decontamination, near_copies, ngrams, quality, simhash, suffixes
from test_suffixes import brute


@pytest.fixture(scope="module")
def long_texts():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(50_000)]
    prose = " ".join(rng.choices(words, k=400_000))
    return [(1, prose), (2, prose + " end"), (3, "x" * 2_000_000), (4, "ab " * 500_000), (5, "short text")]


@pytest.fixture(scope="module")
def long_docs(spark, long_texts):
    return spark.createDataFrame(long_texts, "doc_id long, text string").repartition(3).cache()


def test_near_duplicates(long_docs):
    roots = {r.doc_id: r.root for r in near_copies.groups(long_docs).collect()}
    assert roots[1] == roots[2] and len(set(roots.values())) == 4
    assert len({r.fp for r in simhash.groups(long_docs).collect()}) >= 3


def test_contamination(spark, long_docs, long_texts):
    passage = " ".join(long_texts[0][1].split()[1000:1030])
    bench = spark.createDataFrame([("a", passage), ("b", "ab ab ab")], "item_id string, text string")
    got = {r.doc_id: r for r in decontamination.contamination(long_docs, bench).collect()}
    assert got[1].n_words == 400_000 and got[1].n_hit == 30 and got[2].item_ids == ["a"]
    assert got[4].n_hit == got[4].n_words == 500_000 and got[4].contaminated and got[3].n_hit == 0


def test_scores(long_docs):
    docs = long_docs.withColumn("held_out", F.lit(False))
    got = {r.doc_id: r for r in ngrams.score(docs, ngrams.train(docs)).collect()}
    assert got[1].n_tokens == got[1].n_known == 400_001 and got[3].n_tokens == 2
    labels = long_docs.sparkSession.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in quality.classify(long_docs, labels).collect())


def test_repeats(spark):
    rng = random.Random(3)
    long = "".join(rng.choices("abcdefgh", k=120_000))
    rows = [(1, long), (2, long[50_000:50_400]), (3, "y" * 60_000)]
    got = sorted((r.doc_id, r.n_bytes, len(r.spans), bytes(r.kept)) for r in suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted((i, *w) for (i, _), w in zip(rows, brute([t.encode() for _, t in rows])))
