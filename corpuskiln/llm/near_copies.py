"""Near copies by SimHash, completed: rows whose sets of word shingles have a Jaccard similarity of at least a threshold.

Rows with equal sets are merged first. The sets' fingerprints, whose bits are the majority over their shingles' hashes, are linked by the
pigeonhole blocks of ``simhash``, and a link counts if the sets themselves are at the threshold. Fingerprints that
differ in few bits are the closest copies only: at a similarity of 0.8 most differ in more bits than blocks can
find. So the rest is found by an exact join:

two similar sets share an element among the first n - ceil(similarity * n) + 1 of each, in any one order of the
elements, and where they stand there bounds how many they can share in all. The order puts the shingles that a sample
of texts shows to be common last and goes by hash otherwise; the sample decides how many pairs are compared, never
which are found. A set's sketch has a bit for whether an odd number of its shingles falls there, about two bits a shingle;
two sets differ in at least as many shingles as their sketches in bits, so pairs whose sketches differ in too many
are dropped. The rest is verified on the whole sets, which are made again from the texts of these pairs alone; only
prefixes and sketches are ever dealt as a whole.

A shingle's sets are first compared with one of them, another for each shingle, twice. Then sets of different components
that still meet at a shingle are compared in the join itself, by sizes, places and a sketch of ``BITS`` bits; only pairs
that pass leave it, so a large group of near copies gives no square of its size. 64-bit hashes decide equality of
shingles and of sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import bytes_of, checkpointed, drop, small_batches, text_chunks, written
from .components import components
from .tokens import BASE, mixed, tokenize

SHINGLE, SIMILARITY = 5, 0.8
#: Rounds in which each shingle's sets are compared with one of them.
ROUNDS = 2
#: Rows looked at for common shingles, about, and how many of these are known at most.
SAMPLE, COMMON = 10_000, 300_000
#: Bits of the sketches that are compared in the join.
BITS = 1024


def shingle_sets(texts: list[bytes], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the distinct shingles, ascending within each text; how many each text has).

    A shingle is a run of k words, A-Z in lower case; all words if there are fewer.
    """
    tokens = tokenize(texts)
    text = tokens.text_of()
    end = np.cumsum(tokens.counts)
    at, stop = np.arange(len(text)), end[text]
    start = (at + k <= stop) | (at == (end - tokens.counts)[text])
    at, stop, text = at[start], stop[start], text[start]
    made, power = np.zeros(len(at), np.uint64), np.cumprod(np.full(k, BASE, np.uint64))
    for j in range(k):
        inside = at + j < stop
        made[inside] += tokens.hashes[at[inside] + j] * power[j]
    made = mixed(made).view(np.int64)
    order = np.lexsort((made, text))
    made, text = made[order], text[order]
    first = np.ones(len(made), bool)
    first[1:] = (made[1:] != made[:-1]) | (text[1:] != text[:-1])
    return made[first], np.bincount(text[first], minlength=len(texts))


def _sets(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles of the batch's texts, one set after the other; where each begins, and the end)."""
    hashes, sizes = shingle_sets(bytes_of(batch), k)
    return hashes, np.r_[0, np.cumsum(sizes)]


def _set_keys(hashes: np.ndarray, edge: np.ndarray) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.array([xxh64_intdigest(hashes[a:b].tobytes()) for a, b in zip(edge, edge[1:])], np.uint64).view(np.int64)


def sketch(x: np.ndarray, bits: int = 0) -> bytes:
    """Parities of how many of the shingles x fall to each of ``bits``: if 0, the least power of two that is twice their number, 64 at least."""
    bits = bits or max(64, 1 << max(2 * len(x) - 1, 0).bit_length())
    odd = np.bincount((x.view(np.uint64) >> np.uint64(8)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def sketches_differ(a: bytes, b: bytes) -> int:
    """In how many bits two sketches differ, the larger one folded to the smaller one's size."""
    size = min(len(a), len(b)) * 8

    def folded(s: bytes) -> int:
        x, bits = int.from_bytes(s, "little"), len(s) * 8
        while bits > size:
            bits //= 2
            x = (x >> bits) ^ (x & ((1 << bits) - 1))
        return x

    return (folded(a) ^ folded(b)).bit_count()


def _identified(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, text): the key tells rows of one doc_id apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")


def _common(docs: DataFrame, k: int) -> np.ndarray:
    """The shingles that several texts of the sample have, from rare to frequent; at most COMMON."""
    parts = docs.count() // SAMPLE + 1
    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == 0).select("text").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(_sets(batch, k)[0])], names=["x"])

    counted = small_batches(sample).mapInArrow(run, "x long").groupBy("x").count().where("count > 1").orderBy(F.desc("count"), "x").limit(COMMON)
    return np.array([r.x for r in counted.select("x").collect()][::-1], np.int64)


def _rows(docs: DataFrame, k: int, similarity: float) -> DataFrame:
    """(doc_id, text_key, set_key, n, fp, sketch, words, prefix) of each row: of its set the key, size, fingerprint, two sketches and first shingles."""
    common = _common(docs, k)
    by_hash = np.argsort(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            x, edge = _sets(batch, k)
            sizes = np.diff(edge)
            keys = _set_keys(x, edge)
            prints = np.array([simhash.majority(x[a:b].view(np.uint64)) if a < b else 0 for a, b in zip(edge, edge[1:])], np.uint64)
            sketches = pa.array([sketch(x[a:b]) for a, b in zip(edge, edge[1:])], pa.binary())
            words = np.frombuffer(b"".join(sketch(x[a:b], BITS) for a, b in zip(edge, edge[1:])), np.int64)
            words = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * (BITS // 64), pa.int32()), pa.array(words))
            of = np.repeat(np.arange(len(sizes)), sizes)
            rank = np.zeros(len(x), np.int64)
            if len(common) and len(x):
                at = np.minimum(np.searchsorted(common, x, sorter=by_hash), len(common) - 1)
                rank = np.where(common[by_hash[at]] == x, by_hash[at] + 1, 0)
            order = np.lexsort((x, rank, of))
            length = np.where(sizes > 0, sizes - np.ceil(sizes * similarity - 1e-9).astype(np.int64) + 1, 0)
            inside = np.arange(len(x)) - edge[:-1][of] < length[of]
            prefix = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(length)], pa.int32()), pa.array(x[order[inside]]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(keys), pa.array(sizes.astype(np.int32)), pa.array(prints.view(np.int64)), sketches, words, prefix], names=["doc_id", "text_key", "set_key", "n", "fp", "sketch", "words", "prefix"])

    return small_batches(_identified(docs)).mapInArrow(run, "doc_id long, text_key long, set_key long, n int, fp long, sketch binary, words array<long>, prefix array<long>")


def _shared(rows: DataFrame) -> DataFrame:
    """(x, set_key, n, at): the places in the prefixes whose shingle x is in the prefix of another set too.

    Of shingles that are in the prefixes of the same sets (128 bits of their keys' hashes tell), one stays: the
    others give the same pairs again.
    """
    prefixes = rows.groupBy("set_key").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    dealt = prefixes.select("set_key", "n", F.posexplode("prefix").alias("at", "x"))
    members = [F.count("*").alias("c"), *[F.bit_xor(F.xxhash64(F.lit(i), "set_key")).alias(f"m{i}") for i in range(2)]]
    shared = dealt.groupBy("x").agg(*members).where("c > 1").groupBy("c", "m0", "m1").agg(F.min("x").alias("x"))
    shared = checkpointed(shared.select("x"))
    return checkpointed(dealt.join(shared, "x").select("x", "set_key", "n", "at"))


def _fingerprint_links(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets whose fingerprints are equal or linked, to be verified."""
    least = checkpointed(sets.groupBy("fp").agg(F.min("set_key").alias("least")))
    equal = sets.join(least, "fp").select(F.col("set_key").alias("a"), F.col("least").alias("b"))
    edges = simhash.links(least.select("fp"))
    first, second = (least.select(F.col("fp").alias(c), F.col("least").alias(f"{c}_set")) for c in ("a", "b"))
    near = edges.join(first, "a").join(second, "b").select(F.col("a_set").alias("a"), F.col("b_set").alias("b"))
    return equal.unionByName(near).where("a <> b")


def _near_sketches(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sketches differ in no more bits than similar sets of their sizes may in shingles."""
    side = lambda c: sets.select(F.col("set_key").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    share = (1 - similarity) / (1 + similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = (np.asarray(batch.column("na")).astype(np.int64) + np.asarray(batch.column("nb"))) * share + 1e-9
            near = [sketches_differ(a, b) <= m for a, b, m in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), most)]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, k: int, similarity: float, also: DataFrame | None = None) -> DataFrame:
    """(node, root) by the pairs (a, b) at the threshold, and by the links ``also`` (node, root).

    Only the texts of sets that occur in pairs are read again and dealt.
    """
    spark = docs.sparkSession
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = checkpointed(_near_sketches(pairs, sets, similarity))
    ids = pairs.select(F.explode(F.array("a", "b")).alias("set_key")).distinct()
    wanted = checkpointed(sets.join(ids, "set_key").select(F.col("one.doc_id").alias("_id"), F.col("one.text_key").alias("_text")))
    rows = _identified(docs)
    texts = rows.join(wanted, rows["doc_id"].eqNullSafe(wanted["_id"]) & (rows["text_key"] == wanted["_text"]), "left_semi")
    # Rows repeated as a whole give a set once.
    texts = texts.groupBy("doc_id", "text_key").agg(F.first("text").alias("text")).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            x, edge = _sets(batch, k)
            yield pa.RecordBatch.from_arrays([pa.array(_set_keys(x, edge)), pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(x))], names=["set_key", "shingles"])

    whole, path = written(small_batches(texts).mapInArrow(run, "set_key long, shingles array<long>"))
    first, second = whole.select(F.col("set_key").alias("a"), F.col("shingles").alias("_s")), whole.select(F.col("set_key").alias("b"), F.col("shingles").alias("_t"))
    both = F.size(F.array_intersect("_s", "_t"))
    enough = both >= (F.size("_s") + F.size("_t")) * (similarity / (1 + similarity)) - 1e-9
    found = pairs.join(first, "a").join(second, "b").where(enough).select("a", "b")
    if also is not None:
        found = found.unionByName(also.select(F.col("node").alias("a"), F.col("root").alias("b")))
    roots = components(found)
    drop(spark, path)
    return roots


def _possible(similarity: float) -> Column:
    """Whether sets of sizes na, nb that share the elements at places pa, pb of their orders can be at the threshold."""
    sizes = F.least("na", "nb") >= F.greatest("na", "nb") * similarity - 1e-9
    most = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) + F.least("pa", "pb")
    return sizes & (most >= (F.col("na") + F.col("nb")) * (similarity / (1 + similarity)) - 1e-9)


def links(docs: DataFrame, rows: DataFrame, sets: DataFrame, k: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(node, root) over the distinct sets (set_key, n, fp, sketch, words, one) of the rows, for each that is not the least of its component."""
    roots = _verified(_fingerprint_links(sets), docs, sets, k, similarity)
    keys = _shared(rows)
    for step in range(ROUNDS + 1):
        named = keys.join(roots, keys["set_key"] == roots["node"], "left").select("x", "set_key", "n", "at", F.coalesce("root", "set_key").alias("r"))
        open_keys = named.groupBy("x").agg(F.min("r").alias("lo"), F.max("r").alias("hi")).where("lo <> hi").select("x")
        named = checkpointed(named.join(open_keys, "x"))
        side = lambda c: [F.col("set_key").alias(c), F.col("n").alias(f"n{c}"), F.col("at").alias(f"p{c}"), F.col("r").alias(f"r{c}")]
        if step < ROUNDS:
            one = named.groupBy("x").agg(F.min_by(F.struct("set_key", "n", "at", "r"), F.xxhash64(F.lit(step), "x", "set_key")).alias("o")).select("x", "o.*")
            pairs = named.select("x", *side("a")).join(one.select("x", *side("b")), "x").where("ra <> rb")
        else:
            kept = checkpointed(named.join(sets.select("set_key", "words"), "set_key"))
            words = range(BITS // 64)
            with_words = lambda c: kept.select("x", *side(c), *[F.col("words")[i].alias(f"w{c}{i}") for i in words])
            apart = sum((F.bit_count(F.col(f"wa{i}").bitwiseXOR(F.col(f"wb{i}"))) for i in words), F.lit(0))
            first, second = with_words("a").alias("_first"), with_words("b").withColumnRenamed("x", "_x")
            close = (F.col("ra") < F.col("rb")) & _possible(similarity) & (apart <= (F.col("na") + F.col("nb")) * ((1 - similarity) / (1 + similarity)) + 1e-9)
            pairs = first.join(second, (F.col("x") == F.col("_x")) & close)
        roots = _verified(pairs.where(_possible(similarity)).select("a", "b"), docs, sets, k, similarity, roots)
    return roots


def groups(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, text_key, root (a set's key), the same for all rows linked directly or through others.

    Null and blank texts are one group; texts of fewer words than a shingle are one shingle; repeated rows are in
    one group; an empty table gives an empty result; other columns are not looked at. A text is taken whole, in one
    task, with arrays of some 20 times its size.
    """
    docs = docs.select("doc_id", "text")
    rows = checkpointed(_rows(docs, shingle, similarity))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    sets = checkpointed(rows.groupBy("set_key").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("sketch").alias("sketch"), F.first("words").alias("words"), F.min(order).alias("one")))
    roots = links(docs, rows, sets, shingle, similarity)
    return rows.join(roots, rows["set_key"] == roots["node"], "left").select("doc_id", "text_key", F.coalesce("root", "set_key").alias("root"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs, all columns, with one row of each group: see ``simhash.one_of_each``."""
    return simhash.one_of_each(docs, groups(docs, shingle, similarity))
