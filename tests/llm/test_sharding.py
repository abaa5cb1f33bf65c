from collections import Counter, defaultdict
from zlib import crc32

from corpuskiln.llm import sharding


def test_rows_are_placed_evenly(edge, edge_rows, empty):
    got = sharding.shard_rows(edge, 8).collect()
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == sorted(((i, len((t or "").encode()) + 1, crc32((t or "").encode())) for i, t, *_ in edge_rows), key=repr)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    sizes = [len(by[s]) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1
    assert sharding.shard_rows(empty, 8).count() == 0


def test_placement_does_not_depend_on_partitions(edge):
    key = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    assert key(sharding.shard_rows(edge.repartition(1), 5)) == key(sharding.shard_rows(edge.repartition(6), 5))


def sequential(counts, shards, load):
    """Key by key: to the next virtual node clockwise whose shard is not full."""
    nodes, bound, used, out = sharding.ring(shards), sharding.bounds(sum(counts.values()), shards, load), Counter(), []
    for cell in sorted(counts):
        for rank in range(1, counts[cell] + 1):
            at = next((i for i, (c, _) in enumerate(nodes) if c >= cell), 0)
            while used[s := nodes[at % len(nodes)][1]] >= bound[s]:
                at += 1
            out.append((cell, rank, s, used[s]))
            used[s] += 1
    return out


def test_place_equals_one_by_one():
    import random

    rng = random.Random(5)
    for load in (1.0, 1.25):
        for n in (0, 1, 7, 40):
            counts = Counter(rng.randrange(sharding.CELLS) for _ in range(n)) | Counter({rng.randrange(sharding.CELLS): 30} if n else {})
            got = [(c, r, s, slot + r - a) for c, a, b, s, slot in sharding.place(counts, 4, load) for r in range(a, b + 1)]
            assert got == sequential(counts, 4, load)


def test_few_keys_move_when_bounds_are_loose():
    counts = {c: 10 for c in range(sharding.CELLS)}
    where = lambda n: {(c, r): s for c, a, b, s, _ in sharding.place(counts, n, 1.25) for r in range(a, b + 1)}
    before, after = where(8), where(9)
    assert sum(before[k] != after[k] for k in before) / len(before) < 0.3


def test_a_third_of_the_rows_without_id_or_equal(spark):
    """Null ids lie where their texts do; equal rows get slots of their own."""
    rows = [(None, f"text {i}") for i in range(300)] + [(7, "same")] * 300 + [(i, "x") for i in range(1000, 1300)] + [(None, None)] * 20
    docs = spark.createDataFrame([(*r, "a", "b") for r in rows], "doc_id long, text string, _at string, _cell string").repartition(5)
    got = sharding.shard_rows(docs, 8).collect()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert len(got) == len(rows) and {len(x) for x in by.values()} == {115} and all(sorted(x) == list(range(115)) for x in by.values())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len(t or "") + 1, crc32((t or "").encode())) for i, t in rows)
    key = lambda n: sorted((repr(r.doc_id), r.size, r.text_crc32, r.shard, r.slot) for r in sharding.shard_rows(docs.repartition(n), 8).collect())
    assert key(1) == key(9)
