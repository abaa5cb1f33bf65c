"""Language-model scoring with an n-gram trie in Elias-Fano levels.

The model interpolates orders by absolute discounting: p(w | c) = max(n(cw) - D, 0) / n(c) + g(c) p(w | c without its
first word), where g(c) is the part of n(c) that discounting leaves, and the words' own probabilities are additively
smoothed. Every n-gram of training counts from its first occurrence; all counts are over all training documents.

Words are 63-bit hashes; their number in sorted order is their id. (Two of n different words share a hash with a probability
of about n * n / 2 ** 64; they would count as one.) A level's nodes are numbered in order of (context, successor);
contexts of a level are the nodes of the one above. Levels are cut into shards by occurrences: a context takes as much
room as it occurs, and its successors lie in it in order, so that a context with a third of all occurrences lies in many
shards, and a shard has about ``BLOCK`` different n-grams at most. A shard is a file in the shared folder:

* words: the sorted hashes and the running sum of their counts, both Elias-Fano coded;
* other levels: monotone pointers to the ranges of contexts, successor ids relative to
  the context (made monotone over contexts by adding the last value of the range before), the running sum of the
  counts, all Elias-Fano coded, and log probabilities and back-off weights quantised to 16 bits.

Workers memory-map the files; a lookup is a successor search in the context's range. Files are renamed into
place when complete, so a task that runs again does no harm; the folder goes when the driver ends.
"""

from __future__ import annotations

import atexit
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import eliasfano
from .common import bytes_of, checkpointed, shared_dir, small_batches, table, text_chunks
from .eliasfano import EliasFano
from .tokens import tokenize

#: The order of the query: one more exceeds the limits of the check, see the README.
ORDER, DISCOUNT = 2, 0.75
#: Log10 steps of the quantised values.
STEP = 1 / 4096
#: Words in a shard, about.
SHARD_WORDS = 1 << 17
#: Occurrences in a shard of the levels below, and so about as many n-grams at most.
BLOCK = 1 << 21
#: The token that ends each text; words' hashes are at least 1.
END = 0
CHUNK = 4 << 20
#: Different n-grams that a task holds before it sends its counts on.
HELD = 1_500_000


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(63-bit hashes of all tokens, the end of each text too; how many each text has)."""
    tokens = tokenize(texts)
    hashes = np.maximum((tokens.hashes >> np.uint64(1)).astype(np.int64), 1)
    return np.insert(hashes, np.cumsum(tokens.counts), END), tokens.counts + 1


def quantised(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.round(-log10 / STEP), 0, 65535).astype(np.uint16)


def _packed(codes: np.ndarray) -> np.ndarray:
    return np.r_[codes, np.zeros(-len(codes) % 4, np.uint16)].view(np.uint64)


@dataclass
class Level:
    """rows, mass: nodes and occurrences before each shard, and in all. split: contexts at the edges of shards, and how many successors each has."""

    rows: np.ndarray
    mass: np.ndarray
    split: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.zeros(0, np.int64), np.zeros(0, np.int64)))


@dataclass
class Model:
    """Where the files are, and what is known of the levels, words first. block: occurrences in a shard."""

    folder: str
    width: int
    block: int
    levels: list[Level]

    @property
    def words(self) -> int:
        return int(self.levels[0].rows[-1])

    @property
    def total(self) -> int:
        return int(self.levels[0].mass[-1])

    @property
    def order(self) -> int:
        return len(self.levels)

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.total + 0.5 * (self.words + 1)))

    def shard(self, count: np.ndarray, before: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """The shard of an n-gram whose context has so many occurrences, and so many before it."""
        inside = np.minimum((count * (successor / max(self.words, 1))).astype(np.int64), count - 1)
        return (before + inside) // self.block


def _logs(x: np.ndarray) -> np.ndarray:
    return np.log10(np.maximum(x, 1e-16))


def _by(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, its places) for each that occurs; sorted ones cost one look."""
    order = np.argsort(shard, kind="stable")
    own = shard[order]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else own
    for a, b in zip(first, [*first[1:], len(own)]):
        yield int(own[a]), order[a:b]


#: What a quantised value stands for.
POWER = 10.0 ** (np.arange(1 << 16) * -STEP)


class Reader:
    """Looks words and n-grams up in the mapped files."""

    def __init__(self, model: Model):
        self.model, self.files = model, {}

    def file(self, level: int, shard: int) -> tuple:
        """words: hashes, sums; others: first context, pointers, successors, sums, codes, weights. Empty if there is none."""
        if (level, shard) not in self.files:
            path = f"{self.model.folder}/{level}-{shard}"
            found: tuple = ()
            if os.path.exists(path):
                a = eliasfano.mapped(path)
                found = tuple(EliasFano.of(a[k : k + 4]) for k in range(0, 12 if level > 1 else 8, 4))
                if level > 1:
                    found = int(a[12][0]), *found, a[13].view(np.uint16), a[14].view(np.uint16)
            self.files[level, shard] = found
        return self.files[level, shard]

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, counts, occurrences of the words before) of the hashes; -1 and 0 for words that training did not see."""
        ids, counts, before = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        level = self.model.levels[0]
        for s, own in _by(hashes >> self.model.width):
            if not (file := self.file(1, s)):
                continue
            words, sums = file
            x = hashes[own] - (s << self.model.width)
            i = words.successor(x, np.zeros(len(x), np.int64), np.full(len(x), words.size))
            there = np.flatnonzero(i < words.size)
            there = there[words.access(i[there]) == x[there]]
            i, own = i[there], own[there]
            low = sums.access(i)
            ids[own], counts[own], before[own] = level.rows[s] + i, sums.access(i + 1) - low, level.mass[s] + low
        return ids, counts, before

    def counts(self, number: int, nodes: np.ndarray) -> np.ndarray:
        """How often the nodes of a level occur."""
        out = np.zeros(len(nodes), np.int64)
        rows = self.model.levels[number - 1].rows
        for s, own in _by(np.searchsorted(rows, nodes, "right") - 1):
            sums = self.file(number, s)[1 if number == 1 else 3]
            i = nodes[own] - rows[s]
            out[own] = sums.access(i + 1) - sums.access(i)
        return out

    def weights(self, number: int, context: np.ndarray, count: np.ndarray, before: np.ndarray) -> np.ndarray:
        """The back-off weights of contexts of a level."""
        out = np.zeros(len(context))
        first, last = before // self.model.block, (before + count - 1) // self.model.block
        contexts, successors = self.model.levels[number - 1].split
        edge = np.flatnonzero(first != last)
        if len(edge):
            out[edge] = DISCOUNT * successors[np.searchsorted(contexts, context[edge])] / count[edge]
        inner = np.flatnonzero(first == last)
        for s, own in _by(first[inner]):
            own = inner[own]
            low, *_, weights = self.file(number, s)
            out[own] = POWER[weights[context[own] - low]]
        return out

    def find(self, number: int, context: np.ndarray, count: np.ndarray, before: np.ndarray, successor: np.ndarray, places: bool = True) -> tuple[np.ndarray, ...]:
        """For n-grams of a level: (discounted share, 0 if there is none), and with ``places`` (node or -1, occurrences, occurrences before)."""
        share = np.zeros(len(context))
        node, n, ahead = np.full(len(context), -1, np.int64), np.zeros(len(context), np.int64), np.zeros(len(context), np.int64)
        level = self.model.levels[number - 1]
        for s, own in _by(self.model.shard(count, before, successor)):
            if not (file := self.file(number, s)):
                continue
            low, pointers, successors, sums, codes, _ = file
            local = context[own] - low
            inside = (local >= 0) & (local < pointers.size - 1)
            own, local = own[inside], local[inside]
            if not len(own):
                continue
            # Neighbours mostly have the same context, whose range is found once.
            new = np.r_[True, local[1:] != local[:-1]]
            of, local = np.cumsum(new) - 1, local[new]
            begin, end = pointers.access(local), pointers.access(local + 1)
            base = np.zeros(len(local), np.int64)
            later = np.flatnonzero((begin > 0) & (begin < end))
            base[later] = successors.access(begin[later] - 1)
            some = np.flatnonzero((begin < end)[of])
            own, of = own[some], of[some]
            x = base[of] + successor[own]
            i = successors.successor(x, begin[of], end[of])
            there = np.flatnonzero(i < end[of])
            there = there[successors.access(i[there]) == x[there]]
            i, own = i[there], own[there]
            share[own] = POWER[codes[i]]
            if places:
                low_sum = sums.access(i)
                node[own], n[own], ahead[own] = level.rows[s] + i, sums.access(i + 1) - low_sum, level.mass[s] + low_sum
        return (share, node, n, ahead) if places else (share,)

    def distinct(self, context: np.ndarray, successor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(one place of each different pair, which of these each pair is)."""
        width = self.model.words + 1
        if len(context) and int(context.max()) < (1 << 62) // width:
            _, one, which = np.unique(context * width + successor + 1, return_index=True, return_inverse=True)
            return one, which
        return np.arange(len(context)), np.arange(len(context))


def _after(hashes: np.ndarray, ids: np.ndarray, counts: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What each token's predecessor in its text stands for, as a context; -1 where there is none."""
    context = np.full(len(hashes), -1, np.int64)
    context[1:] = np.where(hashes[:-1] != END, ids[:-1], -1)
    return context, np.r_[0, counts[:-1]], np.r_[0, before[:-1]]


def _local(folder: str) -> str:
    if folder.startswith("file:"):
        folder = "/" + folder.removeprefix("file:").lstrip("/")
    if "://" in folder:
        raise ValueError(f"memory-mapped levels need a shared folder with a file path; spark.checkpoint.dir is {folder}")
    return folder


def _counted_words(docs: DataFrame) -> DataFrame:
    """(key, n): how often each token's hash occurs; tasks count first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, n in _held(np.unique(words_of(bytes_of(batch))[0], return_counts=True) for batch in text_chunks(batches, CHUNK)):
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])

    return small_batches(docs.select("text")).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _held(counts: Iterator[tuple]) -> Iterator[tuple]:
    """Sums of the (sorted keys, counts), sent on whenever there are many."""
    held: list[tuple] = []
    size = 0

    def out() -> tuple:
        keys, n = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        return keys[first], np.add.reduceat(n, first)

    for keys, n in counts:
        if len(keys):
            held.append((keys, n))
            size += len(keys)
        if size > HELD:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def _lookups(reader: Reader, hashes: np.ndarray, upto: int, more: bool) -> Iterator[tuple]:
    """First (logs of the words' own probabilities, counts) of the tokens; then for each level to ``upto``: (places that have a context,
    its weight, the n-gram's share, 0 if there is none); with ``more`` last (word ids, context, its count, occurrences before) for the level after."""
    distinct, back = np.unique(hashes, return_inverse=True)
    own = reader.ids(distinct)
    ids, counts, before = (x[back] for x in own)
    yield reader.model.unigram(own[1])[back], counts
    context, count, ahead = _after(hashes, ids, counts, before)
    for number in range(2, upto + 1):
        at = np.flatnonzero(context >= 0)
        one, which = reader.distinct(context[at], ids[at])
        c, k, b, w = context[at][one], count[at][one], ahead[at][one], ids[at][one]
        new = np.flatnonzero(np.r_[True, c[1:] != c[:-1]]) if len(c) else one
        weight = np.repeat(reader.weights(number, c[new], k[new], b[new]), np.diff(np.r_[new, len(c)]))
        known = np.flatnonzero(w >= 0)
        share, *rest = reader.find(number, c[known], k[known], b[known], w[known], more or number < upto)
        shares = np.zeros(len(one))
        shares[known] = share
        yield at, weight[which], shares[which]
        if not rest:
            return
        found = []
        for x, nothing in zip(rest, (-1, 0, 0)):
            of = np.full(len(one), nothing, np.int64)
            of[known] = x
            every = np.full(len(hashes), nothing, np.int64)
            every[at] = of[which]
            found.append(every)
        context, count, ahead = _after(hashes, *found)
    if more:
        yield ids, context, count, ahead


GRAM = "shard long, context long, successor long, n long"


def _counted_grams(docs: DataFrame, model: Model) -> DataFrame:
    """(shard, context, successor, n) of the n-grams one order above the model's; tasks count first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        wide = model.words * model.levels[-1].rows[-1] >= 1 << 62

        def found() -> Iterator[tuple]:
            for batch in text_chunks(batches, CHUNK):
                hashes, _ = words_of(bytes_of(batch))
                *_, (ids, context, count, ahead) = _lookups(reader, hashes, model.order, True)
                at = np.flatnonzero(context >= 0)
                shard = model.shard(count[at], ahead[at], ids[at])
                if wide:
                    order = np.lexsort((ids[at], context[at]))
                    c, w, h = context[at][order], ids[at][order], shard[order]
                    first = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (w[1:] != w[:-1])]) if len(c) else order
                    yield (h[first], c[first], w[first]), np.diff(np.r_[first, len(c)])
                else:
                    keys, one, n = np.unique(context[at] * model.words + ids[at], return_index=True, return_counts=True)
                    yield keys, n, shard[one]

        if wide:
            for (h, c, w), n in found():
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (h, c, w, n)], names=["shard", "context", "successor", "n"])
            return
        # The shard goes with the key: both rise together.
        where: list[tuple] = []

        def keyed() -> Iterator[tuple]:
            for keys, n, shard in found():
                where.append((keys, shard))
                yield keys, n

        for keys, n in _held(keyed()):
            every, shards = (np.concatenate(x) for x in zip(*where))
            order = np.argsort(every, kind="stable")
            shard = shards[order][np.searchsorted(every[order], keys)]
            where.clear()
            columns = shard, keys // model.words, keys % model.words, n
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], names=["shard", "context", "successor", "n"])

    return small_batches(docs.select("text")).mapInArrow(run, GRAM)


def _write_level(grams: DataFrame, model: Model, number: int, shards: int) -> Level:
    """Writes the files of a level from the partial counts (shard, context, successor, n)."""

    def write(shard: int, context: np.ndarray, successor: np.ndarray, n: np.ndarray, reader: Reader) -> tuple:
        order = np.lexsort((successor, context))
        context, successor, n = context[order], successor[order], n[order]
        first = np.flatnonzero(np.r_[True, (context[1:] != context[:-1]) | (successor[1:] != successor[:-1])])
        context, successor, n = context[first], successor[first], np.add.reduceat(n, first)
        low = int(context[0])
        local = context - low
        per = np.bincount(local)
        some = np.flatnonzero(per)
        count = np.ones(len(per), np.int64)
        count[some] = reader.counts(number - 1, some + low)
        pointers = np.r_[0, np.cumsum(per)]
        # Each context's successors go on from the last value before them.
        ends = np.where(per > 0, successor[np.maximum(pointers[1:] - 1, 0)], 0)
        before = np.r_[0, np.cumsum(ends)[:-1]]
        coded = [x for v in (pointers, before[local] + successor, np.r_[0, np.cumsum(n)]) for x in EliasFano.code(v).arrays()]
        codes, weights = quantised(_logs((n - DISCOUNT) / count[local])), quantised(_logs(DISCOUNT * per / count))
        eliasfano.write(f"{model.folder}/{number}-{shard}", [*coded, np.array([low], np.uint64), _packed(codes), _packed(weights)])
        return shard, len(n), int(n.sum()), low, int(per[0]), int(context[-1]), int(per[-1])

    names = ["shard", "rows", "mass", "first", "first_n", "last", "last_n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, columns = Reader(model), [[] for _ in range(4)]
        for batch in batches:
            for held, c in zip(columns, batch.columns):
                held.append(np.asarray(c))
        if not columns[0]:
            return
        shard, *rest = (np.concatenate(c) for c in columns)
        order = np.argsort(shard, kind="stable")
        shard, rest = shard[order], [x[order] for x in rest]
        edge = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(shard) else shard
        made = [write(int(shard[a]), *(x[a:b] for x in rest), reader) for a, b in zip(edge, [*edge[1:], len(shard)])]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*made)], names=names)

    # A row a shard comes back: that is the number of occurrences over BLOCK.
    dealt = grams.repartition(shards, "shard").mapInArrow(run, ", ".join(f"{x} long" for x in names))
    sizes = {r.shard: r for r in dealt.collect()}
    rows, mass, split = np.zeros(shards, np.int64), np.zeros(shards, np.int64), {}
    for s, r in sizes.items():
        rows[s], mass[s] = r.rows, r.mass
        for context, n in {r.first: r.first_n, r.last: r.last_n}.items():
            split[context] = split.get(context, 0) + n
    edges = np.array(sorted(split), np.int64)
    return Level(np.r_[0, np.cumsum(rows)], np.r_[0, np.cumsum(mass)], (edges, np.array([split[c] for c in edges.tolist()], np.int64)))


def train(docs: DataFrame, order: int = ORDER) -> Model:
    """The model of docs(text); null texts count as empty, an empty table gives a model without words.

    Repeated rows count as often as they occur. Each order reads the texts once more. A text is cut into words whole,
    in one task.
    """
    spark = docs.sparkSession
    folder = f"{_local(shared_dir(spark))}/ngrams-{uuid.uuid4().hex}"
    os.makedirs(folder, exist_ok=True)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    words = checkpointed(_counted_words(docs))
    known = words.count()
    shards = 1 << max(0, (-(-known // SHARD_WORDS) - 1).bit_length())
    width = 63 - (shards - 1).bit_length()

    def write_words(key: tuple, rows: pa.Table) -> pa.Table:
        shard = int(key[0].as_py())
        order = np.argsort(np.asarray(rows.column("key")))
        hashes, counts = np.asarray(rows.column("key"))[order], np.asarray(rows.column("n"))[order]
        eliasfano.write(f"{folder}/1-{shard}", EliasFano.code(hashes - (shard << width)).arrays() + EliasFano.code(np.r_[0, np.cumsum(counts)]).arrays())
        return pa.table({"shard": pa.array([shard], pa.int64()), "rows": pa.array([len(hashes)], pa.int64()), "mass": pa.array([int(counts.sum())], pa.int64())})

    sharded = words.withColumn("shard", F.shiftright("key", width)).groupBy("shard")
    # One row per shard comes back: shards have SHARD_WORDS words, so this is the count of words over that.
    sizes = {r["shard"]: r for r in sharded.applyInArrow(write_words, "shard long, rows long, mass long").collect()}
    rows, mass = ([sizes[s][c] if s in sizes else 0 for s in range(shards)] for c in ("rows", "mass"))
    model = Model(folder, width, BLOCK, [Level(np.r_[0, np.cumsum(rows)], np.r_[0, np.cumsum(mass)])])
    for number in range(2, order + 1):
        shards = int(model.levels[-1].mass[-1]) // BLOCK + 1
        model.levels.append(_write_level(_counted_grams(docs, model), model, number, shards))
    return model


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of docs(doc_id, text, held_out): token counts, the unigram score and the model's, both log10.

    A null or empty text has one token, its end. Null ids are kept; repeated rows each get a row; an empty table gives an
    empty result. A text is cut into words whole, in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for batch in text_chunks(batches, CHUNK):
            hashes, sizes = words_of(bytes_of(batch))
            start = np.cumsum(sizes) - sizes
            found = _lookups(reader, hashes, model.order, False)
            base, counts = next(found)
            p = 10.0**base
            for at, weight, share in found:
                p[at] = share + weight * p[at]
            sums = [np.add.reduceat(x, start) for x in ((counts > 0).astype(np.int64), base, np.log10(p))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(sizes), *[pa.array(x) for x in sums]], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "held_out")).mapInArrow(run, SCHEMA)


def is_held_out(doc_id: Column, fold: int = 1) -> Column:
    """Whether crc32 of the id as text leaves the remainder ``fold`` by 5; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("long").cast("string").cast("binary")), F.lit(5)) == fold, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text").withColumn("held_out", is_held_out(F.col("doc_id")))
    model = train(docs.where("NOT held_out"))
    return score(docs, model).withColumn("train_tokens", F.lit(model.total).cast("long"))
