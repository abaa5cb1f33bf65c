import random
from collections import Counter

import numpy as np
import pytest

from corpuskiln.llm import suffixes


def test_inserting_columns_sorts_suffixes():
    rng = random.Random(5)
    for _ in range(60):
        n, width, letters = rng.randint(1, 15), 9, rng.randint(1, 4)
        rows = np.array([[rng.randrange(letters) for _ in range(width)] for _ in range(n)], np.uint8)
        order, common = np.arange(n, dtype=np.int32), np.zeros(n, np.uint8)
        for c in range(width - 1, -1, -1):
            order, common = suffixes.insert_column(order, common, rows[:, c])
            found = [bytes(rows[i, c:]) for i in order]
            assert found == sorted(found)
            same = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert list(common) == [0] + [same(a, b) for a, b in zip(found, found[1:])]


def test_columns_come_back_from_the_scratch_file(monkeypatch):
    monkeypatch.setattr(suffixes, "SCRATCH", 100)
    rng = np.random.default_rng(3)
    blocks = [rng.integers(0, 255, (n, 12), dtype=np.uint8) for n in (5, 1, 30)]
    columns = suffixes.Columns(12)
    for b in blocks:
        columns.append(b)
    assert all((columns.read(c) == np.concatenate(blocks)[:, c]).all() for c in range(12))


def brute(texts):
    counts = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for t in texts:
        mark = np.zeros(len(t) + 1, int)
        for i in range(len(t) - 199):
            if counts[t[i : i + 200]] > 1:
                mark[i] += 1
                mark[i + 200] -= 1
        gone = np.cumsum(mark)[:-1] > 0
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((len(t), runs, bytes(np.frombuffer(t, np.uint8)[~gone])))
    return out


def check(df, rows):
    got = sorted(((r.doc_id, r.n_bytes, len(r.spans), bytes(r.kept)) for r in suffixes.remove_repeats(df).collect()), key=repr)
    want = brute([(t or "").encode() for _, t in rows])
    assert got == sorted(((i, *w) for (i, _), w in zip(rows, want)), key=repr)


def test_edges(edge, edge_rows):
    check(edge, [(r[0], r[1]) for r in edge_rows])


def test_empty(empty):
    assert suffixes.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("collection", [50_000, 3])
def test_random_passages(spark, monkeypatch, collection):
    monkeypatch.setattr(suffixes, "COLLECTION", collection)
    rng = random.Random(9)
    junk = lambda n: "".join(rng.choice("abcé \n") for _ in range(n))
    passages = [junk(rng.randint(150, 420)) for _ in range(4)]
    rows = []
    for i in range(25):
        rows.append((i, "".join(rng.choice([junk(rng.randint(0, 300)), rng.choice(passages), "a" * rng.randint(0, 500), "ab" * rng.randint(0, 250)]) for _ in range(rng.randint(1, 4)))))
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_many_copies_and_one_near_copy(spark):
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefgh é") for _ in range(1500))
    rows = [(i, text) for i in range(10_000)] + [(10_000, text[:700] + "#" + text[701:]), (10_001, "x" + text[900:])]
    rows += [(20_000 + i, f"{i:09d}" * 12 + text[300:480] + f"{-i:09d}" * 12) for i in range(300)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), rows)


def test_query_equals_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(tuple(r) for r in suffixes.query(spark, sf).collect()) == sorted(con.sql(suffixes.SQL).fetchall())
