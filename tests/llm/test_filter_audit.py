import re
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from corpuskiln.llm import buffers, filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def mask(t):
    w = WORD.findall(t)
    fails = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t)))
    return sum(f << k for k, f in enumerate(fails))


def brute(rows, labels):
    """Every order applied step by step to every row."""
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    docs = []
    for i, t, s in rows:
        copy = i is not None and any(j is not None and j < i and (u or "") == (t or "") for j, u, _ in rows)
        docs.append((s or "", mask(t or "") | copy << 4, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        mine, total = [d for d in docs if d[0] == part], dict.fromkeys("ABCDE", 0)
        for p in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(p, 1):
                bit = 1 << "ABCDE".index(f)
                gone = [d for d in left if d[1] & bit]
                left = [d for d in left if not d[1] & bit]
                total[f] += len(gone)
                out[part, "".join(p), step] = [len(left), len(gone), sum(bool(d[1] & bit) for d in mine) - len(gone), sum(d[1] == bit for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone)]
        for (q, p, step), x in out.items():
            if q == part:
                x.append(total[p[step - 1]])
    return sorted((*k, *x) for k, x in out.items())


@pytest.fixture(scope="module")
def cases(edge_rows):
    rows = [(r[0], r[1], ("a", None, "", "b")[k % 4]) for k, r in enumerate(edge_rows)]
    long = " ".join(f"w{k}" for k in range(230))
    rows += [(100, long, "a"), (101, long, "b"), (101, long, "b"), (101, long, "c"), (102, long + " #", "a"), (103, "X " * 300, "b"), (104, long.upper(), "b"), (None, long, "a"), (None, long, "a"), (90, long, "c"), (90, long, "d")]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 110, 3)] + [(101, 1, 0), (101, 0, 1), (None, 1, 1), (5, None, None), (90, 1, 1)]
    return rows, [(i, q, None if x is None else int(x)) for i, q, x in labels]


def test_audit_by_brute_force(spark, cases, empty):
    rows, labels = cases
    docs = spark.createDataFrame([(*r, *"xyz") for r in rows], "doc_id long, text string, source string, part string, mask string, n string")
    marks = spark.createDataFrame([(*x, "k") for x in labels], "doc_id long, quality int, toxic int, part string")
    got = sorted(tuple(r) for r in filter_audit.audit(docs.repartition(3), marks).collect())
    assert got == brute(rows, labels)
    assert len(got) == 600 * len({r[2] or "" for r in rows})
    assert sorted(tuple(r) for r in filter_audit.audit(docs, marks.limit(0)).collect()) == brute(rows, [])
    assert filter_audit.audit(empty, marks).count() == 0


def test_scan_by_brute_force(monkeypatch):
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("aB é#\n\t漢|Z "), int(n))) for n in rng.integers(0, 400, 200)] + ["", " ", "a" * 5000 + " " + "a" * 5000]
    column = pa.array([None, *texts, None, "tail"])
    for block in (64, 1 << 20):
        monkeypatch.setattr(filter_audit, "PIECE", block)
        monkeypatch.setattr(buffers, "BLOCK", block)
        for part in (column, column.slice(7, 50), column.cast(pa.large_string())):
            assert list(filter_audit.masks_of(part)) == [mask(t or "") for t in part.to_pylist()]
    data, edge = buffers.text_buffer(column)
    start, end, counts = buffers.words_in(data, edge, filter_audit._WORD)
    assert list(filter_audit.distinct_words(data, edge, start, end, counts)) == [len(set(WORD.findall(t or ""))) for t in column.to_pylist()]


def test_equal_hashes_are_told_apart(monkeypatch):
    """Were all words of one hash, the counts would still be right."""
    monkeypatch.setattr(filter_audit, "word_hashes", lambda data, start, end: np.zeros(len(start), np.uint64))
    data, edge = buffers.text_buffer(pa.array(["a b a", "", "c c", "ab ba ab x"]))
    start, end, counts = buffers.words_in(data, edge, filter_audit._WORD)
    assert list(filter_audit.distinct_words(data, edge, start, end, counts)) == [2, 0, 1, 3]


def test_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = filter_audit.query(spark, sf), con.sql(filter_audit.SQL)
    assert got.columns == want.columns and sorted(tuple(r) for r in got.collect()) == sorted(want.fetchall())


def test_a_text_of_megabytes():
    text = "word " * 600_000 + "x" * 3_000_000
    assert list(filter_audit.masks_of(pa.array([text]))) == [mask(text)]
