"""Target-distribution importance resampling: documents drawn without replacement by how like a target corpus they are.

1. The words of both corpora, and runs of up to ``max_n`` of them, are counted in hashed buckets: partitions count in numpy,
   Spark adds up. A bucket's gain is the logarithm of how much more often the target has it. These arrays have
   ``buckets`` cells, whatever the corpus, and may be collected.
2. A document's weight is the mean gain of its features, looked up in the array; noise hashed from its id makes the
   highest scores a draw in proportion to the weights.
3. Scores are whole numbers in a fixed range (a logarithm of counts, one of a hash), so a count per score is a bounded table: it gives the
   lowest score that is drawn, and cuts the order into ranges of about ``RANGE_ROWS`` rows; a score with more rows is
   cut by ids. Only eligible rows from that score up are dealt out.
4. Each partition sorts its eligible rows into runs. A range's runs are laid in a scratch file and merged by a tournament tree,
   a block of each in memory, in several passes if they are many; counts of the ranges before make the
   places ranks. The last range stops after the exact number of draws.
"""

from __future__ import annotations

import math
import tempfile
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .buffers import text_buffer, words_in
from .common import checkpointed, small_batches, table, text_chunks, written
from .tokens import WORD_BYTE

BUCKETS, SEED, LEAST_WORDS, PERCENT = 10_000, 2024, 20, 10
#: Rows of a range of the order; rows that a partition sorts at once; rows of a block of a run; runs merged at once.
RANGE_ROWS, RUN_ROWS, BLOCK_ROWS, FAN = 20_000, 200_000, 1024, 64
#: Bytes of a scratch file that stay in memory.
SCRATCH = 8 << 20
#: Features are hashed together byte by byte up to this length, longer ones alone; so many at once.
SHORT, TOGETHER = 64, 1 << 18

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & np.uint32(1), (_CRC >> np.uint32(1)) ^ np.uint32(0xEDB88320), _CRC >> np.uint32(1))


def crc32s(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """zlib's crc32 of each data[start:end]."""
    out, size = np.zeros(len(start), np.uint32), end - start
    for i in np.flatnonzero(size > SHORT):
        out[i] = zlib.crc32(data[start[i] : end[i]])
    short = np.flatnonzero(size <= SHORT)
    for at in range(0, len(short), TOGETHER):
        part = short[at : at + TOGETHER]
        part = part[np.argsort(-size[part].astype(np.int8), kind="stable")]
        begin, n = start[part], size[part]
        value = np.full(len(part), 0xFFFFFFFF, np.uint32)
        # The longest come first, so those with a j-th byte are a prefix.
        for j, k in enumerate(len(part) - np.cumsum(np.bincount(n, minlength=1))[:-1]):
            value[:k] = _CRC[(value[:k] ^ data[begin[:k] + j]) & np.uint32(255)] ^ (value[:k] >> np.uint32(8))
        out[part] = ~value
    return out


def features_of(column: pa.Array, max_n: int = 1, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of all features, the text of each, and how many words each text has."""
    data, edge = text_buffer(column)
    data = _LOWER[data]
    start, end, words = words_in(data, edge, WORD_BYTE)
    if max_n > 1:
        # Words side by side with one space between, so that a run of words is one piece of bytes.
        inside = WORD_BYTE[data]
        keep = inside.copy()
        keep[end[end < len(data)]] = True
        place = np.cumsum(keep) - keep
        data, start, end = np.where(inside, data, 0x20)[keep], place[start], np.append(place, keep.sum())[end]
    text = np.repeat(np.arange(len(words)), words)
    bucket, of = [], []
    for n in range(1, max_n + 1):
        last = len(start) - n + 1
        first = np.flatnonzero(text[: max(last, 0)] == text[n - 1 :]) if last > 0 else np.zeros(0, np.int64)
        bucket.append(crc32s(data, start[first], end[first + n - 1]) % np.uint32(buckets))
        of.append(text[first])
    return np.concatenate(bucket).astype(np.int64), np.concatenate(of), words


def bucket_counts(texts: DataFrame, max_n: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of texts(text) lie in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in text_chunks(batches):
            total += np.bincount(features_of(batch.column("text"), max_n, buckets)[0], minlength=buckets)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(total[cell])], names=["cell", "n"])

    rows = small_batches(texts.select("text")).mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    return out


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of a bucket's share of the target over its share of the documents, one added to each count."""
    s, t = float(own.sum()) + len(own), float(target.sum()) + len(own)
    return np.array([math.floor(1000 * math.log((float(b) + 1) * s / ((float(a) + 1) * t))) for a, b in zip(own, target)], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Gumbel noise in thousandths from a hash of seed and id; null counts as an empty id."""
    h = int(sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, target: DataFrame, max_n: int = 1, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, text_key, n_features, weight, score, eligible (has least_words words)."""
    gain = gains(bucket_counts(docs, max_n, buckets), bucket_counts(target, max_n, buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            bucket, of, words = features_of(batch.column("text"), max_n, buckets)
            n = np.bincount(of, minlength=len(words))
            # Sums of whole numbers below 2^53: exact.
            weight = np.bincount(of, gain[bucket], len(words)).astype(np.int64) // np.maximum(n, 1)
            score = weight + np.array([noise(i, seed) for i in batch.column("doc_id").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(n.astype(np.int64)), pa.array(weight), pa.array(score), pa.array(words >= least_words)], names=["doc_id", "text_key", "n_features", "weight", "score", "eligible"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return small_batches(rows).mapInArrow(run, "doc_id long, text_key long, n_features long, weight long, score long, eligible boolean")


#: A row as numbers, so that rows compare as they are ranked: -score, id (null: the largest), whether it is null, n_features, text_key, weight.
WIDTH, NO_ID = 6, np.iinfo(np.int64).max


def _as_numbers(batch: pa.RecordBatch) -> np.ndarray:
    absent = np.asarray(batch.column("doc_id").is_null())
    ids = np.asarray(batch.column("doc_id").fill_null(NO_ID))
    return np.stack([-np.asarray(batch.column("score")), ids, absent.astype(np.int64), *[np.asarray(batch.column(c)) for c in ("n_features", "text_key", "weight")]], axis=1)


class Ranges:
    """Ranges of the order: of whole scores, and of the ids of a score with many rows."""

    def __init__(self, counts: dict[int, int], ids: dict[int, list[int]], rows: int = RANGE_ROWS):
        """counts: rows by score; ids: for scores with more than ``rows``, where their ranges of ids begin, but for the first."""
        self.starts, self.first, self.ids = [], [], ids
        at, filled = -1, rows
        for score in sorted(counts, reverse=True):
            many = score in ids
            if many or filled + counts[score] > rows:
                at, filled = at + 1, 0
                self.starts.append(-score)
                self.first.append(at)
                if many:
                    at, filled = at + len(ids[score]), rows
                    continue
            filled += counts[score]
        self.count = at + 1

    def of(self, rows: np.ndarray) -> np.ndarray:
        out = np.array(self.first, np.int64)[np.searchsorted(np.array(self.starts, np.int64), rows[:, 0], "right") - 1]
        for score, cuts in self.ids.items():
            mine = rows[:, 0] == -score
            out[mine] += np.searchsorted(np.array(cuts, np.int64), rows[mine, 1], "right")
        return out


def sorted_runs(batches: Iterator[pa.RecordBatch], ranges: Ranges, task: int, rows: int = RUN_ROWS) -> Iterator[pa.RecordBatch]:
    """Blocks (range, run, place, numbers) of the rows, sorted ``rows`` at a time."""
    held, size, number = [], 0, 0

    def give() -> pa.RecordBatch:
        run = np.concatenate(held)
        run = run[np.lexsort(run.T[::-1])]
        of = ranges.of(run)
        new = np.r_[True, of[1:] != of[:-1]]
        begin = np.flatnonzero(new)
        inside = np.arange(len(run)) - np.repeat(begin, np.diff(np.r_[begin, len(run)]))
        cuts = np.flatnonzero(inside % BLOCK_ROWS == 0)
        blocks = pa.ListArray.from_arrays(pa.array(np.r_[cuts, len(run)].astype(np.int32) * WIDTH), pa.array(run.ravel()))
        name = np.full(len(cuts), (task << 20) + number, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(of[cuts]), pa.array(name), pa.array(inside[cuts]), blocks], names=["range", "run", "place", "numbers"])

    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            held.append(_as_numbers(batch.slice(at, rows)))
            size += len(held[-1])
            if size >= rows:
                yield give()
                held, size, number = [], 0, number + 1
    if size:
        yield give()


class Scratch:
    """Sorted runs in a file of the task."""

    def __init__(self):
        self.file, self.end, self.runs = tempfile.SpooledTemporaryFile(max_size=SCRATCH), 0, []

    def append(self, numbers: np.ndarray, new: bool) -> None:
        """More rows of the last run, or of a new one."""
        if new:
            self.runs.append((self.end, self.end))
        self.file.seek(self.end)
        self.file.write(np.ascontiguousarray(numbers).tobytes())
        self.end += numbers.size * 8
        self.runs[-1] = (self.runs[-1][0], self.end)

    def blocks(self, run: int) -> Iterator[np.ndarray]:
        at, end = self.runs[run]
        while at < end:
            n = min(end - at, BLOCK_ROWS * WIDTH * 8)
            self.file.seek(at)
            yield np.frombuffer(self.file.read(n), np.int64).reshape(-1, WIDTH)
            at += n


def tournament(runs: list[Iterator[np.ndarray]]) -> Iterator[np.ndarray]:
    """The rows of sorted runs in order, in pieces that come from one run.

    A node of the tree holds the better of the two runs below it; the root is the next to give. It gives all rows up to the head
    of the best of the others, which lies beside its way to the root, and only that way is played again.
    """
    leaves = 1 << max(0, len(runs) - 1).bit_length()
    block: list[np.ndarray | None] = [next(r, None) for r in runs]
    key: list[list[tuple]] = [[] if b is None else list(map(tuple, b.tolist())) for b in block]
    at = [0] * len(runs)
    # An exhausted run, or a leaf without one, is -1 and loses.
    tree = [-1] * (2 * leaves)
    better = lambda a, b: a if b < 0 or (a >= 0 and (key[a][at[a]], a) <= (key[b][at[b]], b)) else b
    for i in range(len(runs)):
        tree[leaves + i] = i if key[i] else -1
    for i in range(leaves - 1, 0, -1):
        tree[i] = better(tree[2 * i], tree[2 * i + 1])
    while (best := tree[1]) >= 0:
        node, second = leaves + best, -1
        while node > 1:
            second = better(second, tree[node ^ 1])
            node >>= 1
        end = len(key[best]) if second < 0 else max(at[best] + 1, bisect_right(key[best], key[second][at[second]], at[best]))
        yield block[best][at[best] : end]
        at[best] = end
        if end == len(key[best]):
            block[best], at[best] = next(runs[best], None), 0
            key[best] = [] if block[best] is None else list(map(tuple, block[best].tolist()))
        node = leaves + best
        tree[node] = best if key[best] else -1
        while node > 1:
            node >>= 1
            tree[node] = better(tree[2 * node], tree[2 * node + 1])


def merged(scratch: Scratch, fan: int = FAN) -> Iterator[np.ndarray]:
    """All rows of the runs in order; more than ``fan`` runs are first merged into fewer, through another file."""
    while len(scratch.runs) > fan:
        fewer = Scratch()
        for a in range(0, len(scratch.runs), fan):
            new = True
            for piece in tournament([scratch.blocks(i) for i in range(a, min(a + fan, len(scratch.runs)))]):
                fewer.append(piece, new)
                new = False
        scratch.file.close()
        scratch = fewer
    yield from tournament([scratch.blocks(i) for i in range(len(scratch.runs))])
    scratch.file.close()


RESULT = "doc_id long, text_key long, n_features long, weight long, score long, rank long"


def _result(rows: np.ndarray, before: int, draws: int) -> pa.RecordBatch:
    rank = before + 1 + np.arange(len(rows))
    return pa.RecordBatch.from_arrays(
        [pa.array(rows[:, 1], mask=rows[:, 2] == 1), pa.array(rows[:, 4]), pa.array(rows[:, 3]), pa.array(rows[:, 5]), pa.array(-rows[:, 0]), pa.array(rank, mask=rank > draws)],
        names=["doc_id", "text_key", "n_features", "weight", "score", "rank"],
    )


def merge_ranges(batches: Iterator[pa.RecordBatch], before: dict[int, int], draws: int, fan: int = FAN) -> Iterator[pa.RecordBatch]:
    """Ranked rows of the ranges whose blocks come sorted by range, run and place. Beyond the draws nothing is merged, and ranks are null."""

    def given(scratch: Scratch, range_: int) -> Iterator[pa.RecordBatch]:
        place, left = before[range_], draws - before[range_]
        held, size = [], 0
        for piece in merged(scratch, fan):
            held.append(piece)
            size += len(piece)
            if size >= BLOCK_ROWS or size >= left:
                yield _result(np.concatenate(held), place, draws)
                place, left, held, size = place + size, left - size, [], 0
        if size:
            yield _result(np.concatenate(held), place, draws)

    scratch, last = None, (None, None)
    for batch in batches:
        for range_, run, numbers in zip(batch.column("range").to_pylist(), batch.column("run").to_pylist(), batch.column("numbers")):
            if scratch is not None and range_ != last[0]:
                yield from given(scratch, last[0])
                scratch = None
            scratch = scratch or Scratch()
            scratch.append(np.asarray(numbers.values).reshape(-1, WIDTH), (range_, run) != last)
            last = (range_, run)
    if scratch is not None:
        yield from given(scratch, last[0])


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, max_n: int = 1, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, seed: int = SEED, range_rows: int = RANGE_ROWS, run_rows: int = RUN_ROWS, fan: int = FAN) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, text_key (xxhash64 of the text), n_features, weight, score, rank.

    floor(percent * N / 100) of the N documents with least_words words are drawn, those of the highest scores, ties to the smaller
    doc_id (null last), then to fewer features; rank is 1 for the first and null for the rest. target has ``text``. A null text counts
    as empty: no features, weight 0, not eligible. Rows with equal id and text each get a row, and ranks in any order among
    themselves. An empty target gives gains by the documents alone; an empty table gives an empty result. A text is an array
    of bytes in a task, with about twenty times its size in arrays beside it.
    """
    if not 0 <= percent <= 100:
        raise ValueError("percent must lie between 0 and 100")
    rows, _ = written(scores(docs, target, max_n, buckets, least_words, seed))
    eligible = rows.where("eligible")
    found = eligible.groupBy("score").agg(F.count("*").alias("n")).toArrow()
    counts = dict(zip(found["score"].to_pylist(), found["n"].to_pylist()))
    draws = percent * sum(counts.values()) // 100
    own = ["doc_id", "text_key", "n_features", "weight", "score"]
    no_rank = F.lit(None).cast("long").alias("rank")
    if not draws:
        return rows.select(*own, no_rank)
    reached, cut = 0, 0
    for score in sorted(counts, reverse=True):
        reached, cut = reached + counts[score], score
        if reached >= draws:
            break
    counts = {s: n for s, n in counts.items() if s >= cut}
    chosen = eligible.where(F.col("score") >= cut)
    # Where the ids of a score with many rows are cut may be estimated: any cuts give the same ranks.
    many = [s for s, n in counts.items() if n > range_rows]
    ids = {}
    if many:
        parts = max(math.ceil(counts[s] / range_rows) for s in many)
        steps = [k / parts for k in range(1, parts)]
        for r in chosen.where(F.col("score").isin(many)).groupBy("score").agg(F.percentile_approx("doc_id", steps).alias("cuts")).collect():
            ids[r["score"]] = sorted(set(r["cuts"] or []))
    ranges = Ranges(counts, ids, range_rows)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from sorted_runs(batches, ranges, TaskContext.get().partitionId(), run_rows)

    blocks = checkpointed(chosen.select(*own).mapInArrow(runs, "range long, run long, place long, numbers array<long>"))
    sizes = {r["range"]: r["n"] for r in blocks.groupBy("range").agg(F.sum(F.size("numbers") / WIDTH).cast("long").alias("n")).collect()}
    before, total = {}, 0
    for k in sorted(sizes):
        before[k], total = total, total + sizes[k]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from merge_ranges(batches, before, draws, fan)

    drawn = blocks.repartition("range").sortWithinPartitions("range", "run", "place").mapInArrow(merge, RESULT)
    rest = rows.where(~F.col("eligible") | (F.col("score") < cut)).select(*own, no_rank)
    return rest.unionByName(drawn)


def draw(docs: DataFrame, target: DataFrame, name: str = "rank", **options) -> DataFrame:
    """The drawn rows of docs, all columns, with their rank in ``name``; see ``resample``.

    Rows with equal id and text are one document, whose columns are those of any of them, once for each rank that they have.
    """
    ranks = resample(docs.select("doc_id", "text"), target, **options).where("rank IS NOT NULL").groupBy(F.col("doc_id").alias("i"), F.col("text_key").alias("k")).agg(F.collect_list("rank").alias("ranks"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("i"), F.xxhash64("text").alias("k")).groupBy("i", "k").agg(F.first("row").alias("row"))
    ranks = ranks.withColumnsRenamed({"i": "j", "k": "l"})
    return rows.join(ranks, F.col("i").eqNullSafe(F.col("j")) & (F.col("k") == F.col("l"))).select("row.*", F.explode("ranks").alias(name))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "text"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")
