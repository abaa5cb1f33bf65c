import hashlib
import re

import pytest

from corpuskiln.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(rows, items):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(len(w), 13)
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[x]
        names = ",".join(sorted(str(x) for x in found if x is not None))
        out.append((i, len(w), len(hit), len([x for x in found if x is not None]), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def cases(edge_rows):
    item = " ".join(f"w{i}" for i in range(20))
    rows = [(r[0], r[1]) for r in edge_rows]
    rows += [(600, f"Start {item.upper()} end"), (601, " ".join(item.split()[:13]) + " x" * 300), (602, " ".join(item.split()[:12])), (603, "one two one two"), (604, "w1 w2 w3, w4"), (605, item + " " + item), (605, item + " " + item)]
    items = [(1, item), (2, "one two"), (3, ""), (4, None), (5, "--"), (None, "w3 w4"), (6, item), (70, " ".join(item.split()[2:18])), (8, "one two")]
    return rows, items


@pytest.mark.parametrize("parts", [1, 4])
def test_matches_brute_force(spark, cases, monkeypatch, parts):
    rows, items = cases
    if parts > 1:
        monkeypatch.setattr(D, "MAX_WINDOWS", 5)
        monkeypatch.setattr(D.hits, "__defaults__", (13, 5))
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, key string, items string")
    bench = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, w string")
    from pyspark.sql import functions as F

    got = D.contamination(docs, bench).select("doc_id", "n_words", "n_hit", F.size("item_ids"), F.sha2(F.concat_ws(",", "item_ids"), 256), "contaminated").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, items)


def test_removal(spark, cases, empty):
    rows, items = cases
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, key string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    bad = {x[0] for x in brute(rows, items) if x[5]}
    kept = D.remove_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted((r.doc_id or -1) for r in kept.collect()) == sorted((i or -1) for i, _ in rows if i not in bad)
    assert D.remove_contaminated(docs, bench.limit(0)).count() == len(rows) and D.contamination(empty, bench).count() == 0
