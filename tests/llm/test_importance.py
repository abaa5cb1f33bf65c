import math
import re
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from corpuskiln.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text, max_n):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return len(w), [" ".join(w[k : k + n]) for n in range(1, max_n + 1) for k in range(len(w) - n + 1)]


def brute(rows, items, percent=10, max_n=1, least=20, buckets=10000):
    bucket = lambda t: [crc32(g.encode()) % buckets for g in grams(t, max_n)[1]]
    own, target = [0] * buckets, [0] * buckets
    for texts, count in (([t for _, t in rows], own), (items, target)):
        for t in texts:
            for b in bucket(t):
                count[b] += 1
    gain = [math.floor(1000 * math.log((t + 1) * (sum(own) + buckets) / ((s + 1) * (sum(target) + buckets)))) for s, t in zip(own, target)]
    out = []
    for i, t in rows:
        b = bucket(t)
        weight = sum(gain[x] for x in b) // len(b) if b else 0
        h = int(sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, grams(t, max_n)[0] >= least])
    drawn = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(drawn[: percent * len(drawn) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def cases(edge_rows):
    rng = np.random.default_rng(9)
    words = [f"w{k}" for k in range(60)] + ["é", "WORD", "x" * 70]
    rows = [(r[0], r[1]) for r in edge_rows] + [(1000 + k, " ".join(rng.choice(words, int(rng.integers(5, 60))))) for k in range(300)]
    return rows + rows[30:40] + [(None, rows[50][1]), (None, rows[50][1])], [" ".join(words[:20]), None, "", "w1 w2 w3 -- W1"]


@pytest.mark.parametrize("options", [{}, {"percent": 35, "max_n": 3, "buckets": 97}, {"percent": 100, "least_words": 0}, {"percent": 0}])
def test_by_brute_force(spark, cases, options):
    rows, items = cases
    docs = spark.createDataFrame([(*r, *"abc") for r in rows], "doc_id long, text string, score string, rank string, eligible string").repartition(5)
    target = spark.createDataFrame([(t, "x") for t in items], "text string, score string")
    names = {"least_words": "least"}
    want = brute(rows, items, **{names.get(k, k): v for k, v in options.items()})
    assert rows_of(importance.resample(docs, target, **options)) == want
    # Many ranges, many short runs, and merges in several passes.
    assert rows_of(importance.resample(docs, target, range_rows=7, run_rows=5, fan=2, **options)) == want


def test_edges(spark, cases, empty):
    rows, items = cases
    docs = spark.createDataFrame([(*r, *"abc") for r in rows], "doc_id long, text string, row string, ranks string, i string")
    target = spark.createDataFrame([(t,) for t in items], "text string")
    assert rows_of(importance.resample(docs, target.limit(0))) == brute(rows, [])
    assert importance.resample(empty, target).count() == 0 and importance.draw(empty, target).count() == 0
    got = importance.draw(docs, target, percent=50, name="nth")
    assert got.columns == [*docs.columns, "nth"]
    want = {r[4]: r[0] for r in brute(rows, items, percent=50) if r[4]}
    assert {r.nth: r.doc_id for r in got.collect()} == want and sorted(want) == list(range(1, len(want) + 1))
    with pytest.raises(ValueError):
        importance.resample(docs, target, percent=101)


def test_one_score_of_many_rows_is_cut(spark):
    """Rows without features or with one id all have equal scores: ids, then places, cut them."""
    text = "a b c d e f g h i j k l m n o p q r s t u"
    docs = spark.createDataFrame([(7, text)] * 200 + [(None, text)] * 100, "doc_id long, text string").repartition(4)
    target = spark.createDataFrame([("a b",)], "text string")
    got = importance.resample(docs, target, percent=90, range_rows=20, run_rows=16).collect()
    ranks = sorted(r["rank"] for r in got if r["rank"])
    assert ranks == list(range(1, 271)) and len(got) == 300
    best = max(got, key=lambda r: r.score)
    assert all(r["rank"] for r in got if r.score == best.score)


def test_ranges_follow_the_order():
    counts = {5: 3, 4: 50, 3: 1, 2: 30, 1: 2}
    ranges = importance.Ranges(counts, {4: [10, 20], 2: [5]}, 10)
    rows = np.array([[-5, 9, 0, 0, 0, 0], [-4, 1, 0, 0, 0, 0], [-4, 10, 0, 0, 0, 0], [-4, 25, 0, 0, 0, 0], [-3, 0, 0, 0, 0, 0], [-2, 4, 0, 0, 0, 0], [-2, 6, 0, 0, 0, 0], [-1, 6, 0, 0, 0, 0]])
    of = list(ranges.of(rows))
    assert of == sorted(of) and of[0] < of[1] < of[2] < of[3] < of[4] < of[5] < of[6] < of[7]


def test_hashes_and_tournaments():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    start = rng.integers(0, 4000, 400)
    end = start + rng.integers(0, 300, 400)
    assert list(importance.crc32s(data, start, end)) == [crc32(data[a:b].tobytes()) for a, b in zip(start, end)]
    for k in (0, 1, 2, 5, 9):
        runs = [np.sort(rng.integers(0, 50, (int(n), 1)), axis=0) for n in rng.integers(0, 40, k)]
        got = list(importance.tournament([iter(np.array_split(r, 3)) if len(r) > 3 else iter([r] if len(r) else []) for r in runs]))
        want = sorted(x for r in runs for x in r[:, 0].tolist())
        assert [x for p in got for x in p[:, 0].tolist()] == want


def test_a_text_of_megabytes():
    text = "Word " * 400_000 + "x" * 2_000_000
    bucket, of, words = importance.features_of(pa.array([text, "b"]), 2)
    assert list(words) == [400_001, 1] and len(bucket) == 400_001 + 400_000 + 1 and bucket[0] == crc32(b"word") % 10000 and bucket[400_000] == crc32(b"x" * 2_000_000) % 10000
