import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from corpuskiln.llm import near_copies
from test_simhash import roots


def shingles(text, k=5):
    words = text.encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def similar(a, b, least=0.8):
    return a == b or bool(a and b) and len(a & b) >= least * len(a | b) - 1e-9


def partition(ids, labels):
    of = {}
    for i, x in zip(ids, labels):
        of.setdefault(x, set()).add(i)
    return {frozenset(g) for g in of.values()}


def texts():
    """Bases with copies of a few changed words, chains of copies, and a line in every third text."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    line = " ".join(f"common{i}" for i in range(12))
    made = []
    for k in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([3, 8, 40, 120, 400]))]
        for _ in range(rng.choice([1, 2, 6, 20])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 30))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            made.append(" ".join(copy) + (" " + line if k % 3 == 0 else ""))
            base = copy if rng.random() < 0.3 else base
    return [*made, "", " \n", line, line.upper(), made[0] + "\n"]


def test_groups_match_brute_force(spark):
    rows = list(enumerate(texts()))
    sets = {i: shingles(t) for i, t in rows}
    edges = [(i, j) for i in sets for j in sets if i < j and similar(sets[i], sets[j])]
    root = roots(list(sets), edges)
    got = near_copies.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(rows)
    assert partition([r.doc_id for r in got], [r.root for r in got]) == partition(root, root.values())


def test_pipeline_leaves_no_near_copies(spark, sf):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(2000)]
    base = [[rng.choice(words) for _ in range(120)] for _ in range(20)]
    copies = []
    for b in base:
        copy = list(b)
        for at in (30, 80):
            copy[at] = "changed"
        copies.append(copy)
    assert all(similar(shingles(" ".join(a)), shingles(" ".join(b))) for a, b in zip(base, copies))
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate([*base, *copies])], "doc_id long, text string")
    kept = corpus_pipeline.keep_one_of_near_copies(spark, docs, sf)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(20))


@settings(deadline=None, max_examples=60)
@given(st.integers(0, 10_000), st.integers(0, 300), st.integers(0, 80), st.integers(0, 80))
def test_sketches_never_differ_in_more_than_the_sets(seed, common, only_a, only_b):
    x = np.unique(np.random.default_rng(seed).integers(-(1 << 63), 1 << 63, common + only_a + only_b))
    a, b = x[: common + only_a], np.concatenate([x[:common], x[common + only_a :]])
    assert near_copies.sketches_differ(near_copies.sketch(a), near_copies.sketch(b)) <= only_a + only_b


def test_edges(edge, edge_rows, empty):
    kept = near_copies.keep_one(edge)
    assert kept.columns == edge.columns and near_copies.keep_one(empty).count() == 0
    rows = kept.collect()
    assert len(rows) == near_copies.groups(edge).select("root").distinct().count()
    assert {(r.doc_id, r.text) for r in rows} <= {(r[0], r[1]) for r in edge_rows}
