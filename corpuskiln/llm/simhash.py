"""SimHash near-duplicates by pigeonhole blocks.

A 64-bit fingerprint is cut into six blocks. Of two fingerprints that differ in at most three
bits at least three blocks are equal, so for one of the 20 choices of three blocks both have the
same 32-bit key. Distinct fingerprints (copies are merged first) are dealt by these keys, and a
key's fingerprints are linked by comparing them; a key gives a spanning star of each linked set,
never all its pairs. Components of the stars, at the level of fingerprints, give the groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bytes_of, checkpointed, free_name, small_batches, table, text_chunks
from .components import components

SEED = 42
SHINGLE = 3
BITS = 3
#: Equal blocks that make a key; there are as many more as bits may differ.
SAME = 3
#: Fingerprints of a key that are compared with each other as they are.
PLAIN = 1024


def shingle_hashes(text: bytes, k: int = SHINGLE) -> list[int]:
    """XXH64 of each run of k words, A-Z in lower case and joined by spaces; of all words if there are fewer."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    return [xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[min(k, len(words)) - 1 :])]


def majority(hashes: list[int]) -> int:
    """The bits that are set in over half of the hashes."""
    array = np.array(hashes, np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(array), 1 << 14):
        counts += np.unpackbits(array[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    bits = (counts * 2 > len(array)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, fp): fp is the fingerprint as a signed long, text_key tells rows of one doc_id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            made = np.array([majority(h) if (h := shingle_hashes(t)) else 0 for t in bytes_of(batch)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(made.view(np.int64))], names=["doc_id", "text_key", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    return small_batches(rows).mapInArrow(run, "doc_id long, text_key long, fp long")


def masks(bits: int = BITS, same: int = SAME) -> list[int]:
    """For each choice of ``same`` of ``bits`` + ``same`` blocks, the mask of their bits as a signed long."""
    blocks = bits + same
    edge = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << (edge[i + 1] - edge[i])) - 1) << edge[i] for i in range(blocks)]
    made = [sum(block[i] for i in c) for c in combinations(range(blocks), same)]
    return [m - (1 << 64) if m >> 63 else m for m in made]


def stars(fps: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """(root, others linked to it directly or through others) for the linked sets among fps.

    Each fingerprint reached is compared only with those not reached yet.
    """
    left = fps
    while len(left) > 1:
        root, todo, left = left[0], [left[0]], left[1:]
        while todo and len(left):
            near = np.bitwise_count(left ^ todo.pop()) <= bits
            if near.any():
                found, left = left[near], left[~near]
                yield root, found
                todo.extend(found)


def split_stars(fps: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """As ``stars``; many fingerprints are compared only where one of bits + 1 parts of the bits in which they vary is equal."""
    varying = [b for b in range(64) if int(np.bitwise_or.reduce(fps ^ fps[0])) >> b & 1]
    if len(fps) <= PLAIN or len(varying) <= bits:
        yield from stars(fps, bits)
        return
    for part in np.array_split(varying, bits + 1):
        own = fps & np.uint64(sum(1 << int(b) for b in part))
        order = np.argsort(own, kind="stable")
        first = np.flatnonzero(np.r_[True, own[order][1:] != own[order][:-1]])
        for a, b in zip(first, [*first[1:], len(fps)]):
            if b - a > 1:
                yield from stars(fps[order[a:b]], bits)


def _links(keys: np.ndarray, fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges among rows sorted by key."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    size = np.diff(np.r_[first, len(keys)])
    two = first[size == 2]
    two = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= bits]
    a, b = [fps[two]], [fps[two + 1]]
    for at, n in zip(first[size > 2], size[size > 2]):
        for root, found in split_stars(fps[at : at + n], bits):
            a.append(np.full(len(found), root))
            b.append(found)
    return np.concatenate(a), np.concatenate(b)


def links(distinct: DataFrame, bits: int = BITS) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints ``fp``; linked sets within a key come as stars."""
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks(bits))])
    dealt = distinct.select("fp", F.explode(keys).alias("key")).repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((np.asarray(batch.column("key")), np.asarray(batch.column("fp")).view(np.uint64)))
            size += batch.num_rows
            if size < 1 << 16 or held[0][0][0] == held[-1][0][-1]:
                continue
            keys, fps = (np.concatenate(x) for x in zip(*held))
            last = int(np.searchsorted(keys, keys[-1]))
            yield out(*_links(keys[:last], fps[:last], bits))
            held, size = [(keys[last:], fps[last:])], len(keys) - last
        if held:
            yield out(*_links(*(np.concatenate(x) for x in zip(*held)), bits))

    def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def groups(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, text_key, fp, root (a fingerprint of the group), component_id.

    component_id is the smallest doc_id of the group, null if no row of it has an id. A null or
    blank text has fingerprint 0 and links like any other; repeated rows are in one group; an empty
    table gives an empty result; other columns are not looked at.
    """
    rows = checkpointed(fingerprints(docs))
    distinct = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct, bits))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("fp", "root", "component_id")
    return rows.join(named, "fp").select("doc_id", "text_key", "fp", "root", "component_id")


def keep_one(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """The rows of docs, all columns, with one row of each group: that of the smallest doc_id (null ids last)."""
    return one_of_each(docs, groups(docs, bits))


def one_of_each(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """The rows of docs, all columns, with one row of each root in grouped(doc_id, text_key, root).

    It is that of the smallest doc_id (null ids last), then of the smallest text key; of rows that share
    both, the one whose columns, written as JSON, come first. Column names of docs may be any.
    """
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    kept = grouped.groupBy("root").agg(F.min(order).alias("w"), F.count("*").alias("n"))
    id_name, text_name = free_name(docs, "_kept_id"), free_name(docs, "_kept_text")
    kept = checkpointed(kept.select(F.col("w.doc_id").alias(id_name), F.col("w.text_key").alias(text_name)))
    mine = docs["doc_id"].cast("long").eqNullSafe(kept[id_name]) & (F.xxhash64(docs["text"]) == kept[text_name])
    rows = docs.join(kept, mine, "left_semi")
    # Rows that share doc_id and text with a kept one: only these are compared as whole rows.
    key = [F.col("doc_id").cast("long").alias(id_name), F.xxhash64("text").alias(text_name)]
    again = checkpointed(rows.select(*key).groupBy(id_name, text_name).count().where("count > 1").select(id_name, text_name))
    if again.isEmpty():
        return rows
    same = rows["doc_id"].cast("long").eqNullSafe(again[id_name]) & (F.xxhash64(rows["text"]) == again[text_name])
    several = rows.join(again, same, "left_semi")
    once = several.select(*key, F.struct(*docs.columns).alias("_row")).groupBy(id_name, text_name).agg(F.min_by("_row", F.to_json("_row")).alias("_row")).select("_row.*")
    return rows.join(again, same, "left_anti").unionByName(once)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
