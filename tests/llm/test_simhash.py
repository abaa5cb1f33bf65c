import random

import numpy as np
import xxhash

from corpuskiln.llm import simhash
from corpuskiln.llm.components import components

WHITE = " \t\n\r\x0b\x0c"


def fingerprint(text):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    for n, m in ((1, 0), (30, 20), (60, 50)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(n - 1) if i % 7]
        got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        want = roots(range(n), edges)
        assert got == {k: v for k, v in want.items() if k != v}


def test_links_find_all_components(spark):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for f in list(fps):
        for _ in range(rng.randint(0, 6)):
            for b in rng.sample(range(64), rng.randint(1, 4)):
                f ^= 1 << b
            fps.add(f)
    # One dense cluster, whose keys hold many fingerprints.
    center = rng.getrandbits(64)
    fps |= {center ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)}
    signed = [int(np.uint64(f).astype(np.int64)) for f in sorted(fps)]
    df = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    edges = [(r.a, r.b) for r in df.collect()]
    array = np.array(signed, np.int64).view(np.uint64)
    true = [(signed[i], signed[int(j)]) for i in range(len(signed)) for j in np.flatnonzero(np.bitwise_count(array[i] ^ array) <= 3) if i < j]
    assert set(map(frozenset, edges)) - set(map(frozenset, true)) == set() or roots(signed, edges) == roots(signed, true)
    assert roots(signed, edges) == roots(signed, true)
    assert len(edges) < len(true)


def test_groups_on_edges(edge, edge_rows, empty):
    got = simhash.groups(edge).collect()
    assert len(got) == len(edge_rows)
    prints = {(r[0], r[1]): fingerprint(r[1] or "") for r in edge_rows}
    assert sorted(int(np.int64(r.fp).view(np.uint64)) for r in got) == sorted(fingerprint(r[1] or "") for r in edge_rows)
    distinct = sorted(set(prints.values()))
    root = roots(distinct, [(a, b) for a in distinct for b in distinct if a < b and (a ^ b).bit_count() <= 3])
    least = {}
    for (i, _), f in prints.items():
        if i is not None:
            least[root[f]] = min(least.get(root[f], i), i)
    want = sorted(((i, least.get(root[f])) for (i, t), f in [((r[0], r[1]), fingerprint(r[1] or "")) for r in edge_rows]), key=repr)
    assert sorted(((r.doc_id, r.component_id) for r in got), key=repr) == want
    assert simhash.groups(empty).count() == 0


def test_one_of_each_group_stays(edge, edge_rows, empty):
    kept = simhash.keep_one(edge)
    assert kept.columns == edge.columns and simhash.keep_one(empty).count() == 0
    rows = kept.collect()
    groups = simhash.groups(edge).select("root").distinct().count()
    assert len(rows) == groups
    have = [(r.doc_id, r.text) for r in rows]
    assert set(have) <= {(r[0], r[1]) for r in edge_rows} and len(have) == len(set(have))
    assert (0, edge_rows[0][1]) in have and (12, edge_rows[0][1]) not in have
