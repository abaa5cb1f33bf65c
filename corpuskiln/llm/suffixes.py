"""Removal of repeated 200-byte strings with column-wise suffix sorting of many strings.

A Burrows-Wheeler transform that is built a column at a time needs as many rounds as its longest
string has symbols, and every round goes over all strings; over whole documents that is hopeless. So:

1. Anchors. In every 200-byte window the ``GRAM``-byte string of the least hash is an anchor; equal
   windows have the same anchors at the same places. An anchor's segment, what lies within a window's
   reach of it (``SEGMENT`` bytes at most), holds all windows around it.
2. Anchors whose string occurs once are dropped. Segments that are equal as a whole (128 bits of hashes) form a class,
   which goes on as one segment that knows whether it stands for several places.
3. Every window has the ``HALF`` bytes before its anchor or those after it. A segment gives a piece for each half that
   it shares with another class, or for both if it stands for several places. Pieces are dealt by anchor and half, their
   core, so that equal windows meet and no frequent anchor comes to one task as a whole.
4. A piece is ``HALF`` bytes left of its core, the core (one symbol), and ``HALF`` bytes right of it; a window is the core with x
   bytes of the left and ``HALF`` - x of the right. The strings of a collection are aligned at their cores, so a round inserts one symbol of each,
   the next to the left: the suffixes that begin there are brought in order from their order one symbol before, which gives a column of the transform
   and its common prefixes. Suffixes with ``HALF`` + 1 common symbols begin with equal windows. Columns of symbols are
   read one after the other from a sequential scratch file; the order and the common prefixes are all that a round keeps.
5. What the transform finds for a class holds for all its places.

The scratch file stays in memory up to ``SCRATCH`` bytes; beyond, it is private to the running task, like Spark's
spill files, and a task that is lost is run again from its input. Pieces of one core are in one task: 168 bytes
each in the scratch file and about 40 in memory, for each different surrounding that the core has.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, checkpointed, small_batches, table, text_chunks
from .tokens import BASE, BYTE_VALUE, mixed

WINDOW, GRAM = 200, 32
#: Bytes that a window reaches to the left of an anchor it holds.
REACH = WINDOW - GRAM
SEGMENT = REACH + WINDOW
#: Every window has the anchor's HALF bytes before it or those after it.
HALF = REACH // 2
#: A byte that UTF-8 does not have, for what lies outside the text.
OUTSIDE = 0xFF
#: Pieces in one transform, unless one core has more.
COLLECTION = 50_000
#: Bytes of a collection's columns that are held in memory.
SCRATCH = 64 << 20

_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def _slide(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minima (or maxima) of x[i : i + width], 32-bit, for each i with a full window."""
    op = np.minimum if least else np.maximum
    n = len(x) - width + 1
    fill = np.array(0xFFFFFFFF if least else 0, x.dtype)
    blocks = np.concatenate([x, np.full(-len(x) % width, fill)]).reshape(-1, width)
    ahead = op.accumulate(blocks, axis=1).ravel()
    behind = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(behind[:n], ahead[width - 1 : width - 1 + n])


_powers: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 1 to n at least of the hashes' base and of its inverse, kept for the next call."""
    if len(_powers[0]) < n:
        _powers[:] = [np.cumprod(np.full(n + n // 4, b, np.uint64)) for b in (BASE, _INVERSE)]
    return _powers[0], _powers[1]


class Prefix:
    """Hashes of any data[a:b] by prefix sums."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUE[data] * power[: len(data)], out=self.sums[1:])

    def hashes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mixed((self.sums[b] - self.sums[a]) * self.inverse[a] + (b - a).astype(np.uint64))


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, place, hash of the anchor, hash of its segment, hashes of it with HALF bytes before and after) of all anchors of the texts.

    The last two are 0 where the text has not so many bytes there.
    """
    sizes = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    none = np.zeros(0, np.int64)
    if len(data) < WINDOW:
        return none, none, *[none.astype(np.uint64)] * 4
    edge = np.r_[0, np.cumsum(sizes)]
    prefix = Prefix(data)
    place = np.arange(len(data) - GRAM + 1)
    grams = prefix.hashes(place, place + GRAM)
    valid = np.zeros(len(data) + 1, np.int32)
    long = sizes >= WINDOW
    np.add.at(valid, edge[:-1][long], 1)
    np.add.at(valid, edge[1:][long] - WINDOW + 1, -1)
    valid = np.cumsum(valid[: len(data) - WINDOW + 1]).astype(bool)
    # The upper halves order the anchors; equal ones are anchors alike.
    order = (grams >> np.uint64(32)).astype(np.uint32)
    least = _slide(order, REACH + 1, True)
    least[~valid] = 0
    # Place p is an anchor if a window that starts at p - REACH ... p has its hash as the least.
    pad = np.zeros(REACH, np.uint32)
    p = np.flatnonzero(_slide(np.r_[pad, least, pad], REACH + 1, False) == order)
    text = np.searchsorted(edge, p, "right") - 1
    a, b = np.maximum(p - REACH, edge[text]), np.minimum(p + WINDOW, edge[text + 1])
    # Where the anchor lies in its segment counts: two anchors of a short text may have the same segment.
    segment = mixed(prefix.hashes(a, b) + (p - a).astype(np.uint64))
    left = np.where(p - HALF >= a, prefix.hashes(np.maximum(p - HALF, 0), p + GRAM), np.uint64(0))
    right = np.where(p + GRAM + HALF <= b, prefix.hashes(p, np.minimum(p + GRAM + HALF, len(data))), np.uint64(0))
    return text, p - edge[text], grams[p], segment, left, right


class Columns:
    """The symbols of a collection, column by column, in a sequential scratch file."""

    def __init__(self, width: int):
        self.width, self.blocks, self.size = width, [], 0
        self.file = tempfile.SpooledTemporaryFile(max_size=SCRATCH)

    def append(self, rows: np.ndarray) -> None:
        """rows: one of ``width`` bytes per string."""
        self.blocks.append((self.width * self.size, len(rows)))
        self.file.write(np.ascontiguousarray(rows.T).tobytes())
        self.size += len(rows)

    def read(self, column: int) -> np.ndarray:
        out = np.empty(self.size, np.uint8)
        at = 0
        for start, n in self.blocks:
            self.file.seek(start + column * n)
            out[at : at + n] = np.frombuffer(self.file.read(n), np.uint8)
            at += n
        return out

    def close(self) -> None:
        self.file.close()


def insert_column(order: np.ndarray, common: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the strings' suffixes, and their common prefixes, after a symbol went before each.

    order: strings by the suffix so far; common[i]: symbols that it shares with the one before; symbols: one per
    string. Equal symbols keep the order of what follows them; between two neighbours with the same one the common
    prefix is the least on the way from one to the other, and one more.
    """
    column = symbols[order]
    moved = np.argsort(column, kind="stable")
    column = column[moved]
    least = np.minimum.reduceat(np.append(common, 255).astype(np.uint8), moved + 1)
    grown = np.zeros(len(order), np.uint8)
    grown[1:] = np.where(column[1:] == column[:-1], least[:-1] + 1, 0)
    return order[moved], grown


def repeated_windows(columns: Columns, core: np.ndarray, left: np.ndarray, right: np.ndarray, several: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) x per piece, such that the window with x bytes left of the core also starts elsewhere; (0, -1) if none does.

    columns: 2 * HALF bytes per piece, in order of the text; core: its number; left, right: how many of the bytes
    lie in the text; several: whether the piece stands for more than one place.
    """
    n = len(core)
    order, common = np.arange(n, dtype=np.int32), np.zeros(n, np.uint8)
    least, most = np.zeros(n, np.int16), np.full(n, -1, np.int16)
    for c in range(2 * HALF - 1, HALF - 1, -1):
        order, common = insert_column(order, common, columns.read(c))
    for x in range(HALF + 1):
        order, common = insert_column(order, common, columns.read(HALF - x) if x else core)
        same = common > HALF
        again = same | several[order]
        again[:-1] |= same[1:]
        found = order[again]
        found = found[(left[found] >= x) & (right[found] >= HALF - x)]
        least[found[most[found] < 0]] = x
        most[found] = x
    return least, most


def _merged(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """The spans joined where they overlap or touch."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.r_[True, start[1:] > end[:-1]]
    firsts = np.flatnonzero(new)
    return list(zip(start[firsts].tolist(), end[np.r_[firsts[1:] - 1, len(end) - 1]].tolist()))


def _anchor_rows(rows: DataFrame) -> DataFrame:
    """(key, at, gram, segment, left, right) of the anchors of rows(key, text).

    Of a text that a task meets more than twice, two copies give rows: more say nothing more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[bytes, int] = {}
        for batch in text_chunks(batches, CHUNK_BYTES):
            keys = batch.column("key").to_pylist()
            wanted = []
            for i, key in enumerate(keys):
                met[key] = met.get(key, 0) + 1
                if met[key] <= 2:
                    wanted.append(i)
            if not wanted:
                continue
            batch = batch.take(pa.array(wanted))
            text, place, *hashes = anchors(batch.column("text").cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(text)), pa.array(place.astype(np.int32)), *[pa.array(h.view(np.int64)) for h in hashes]], names=["key", "at", "gram", "segment", "left", "right"])

    return small_batches(rows).mapInArrow(run, "key binary, at int, gram long, segment long, left long, right long")


def _once_a_task(rows: DataFrame) -> DataFrame:
    """rows(key, text) without further copies of a text that its task has met, so that few copies are dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()
        for batch in batches:
            keys = batch.column("key").to_pylist()
            new = [not (k in met or met.add(k)) for k in keys]
            yield batch.filter(pa.array(new, pa.bool_()))

    return small_batches(rows).mapInArrow(run, "key binary, text string")


PIECE = "gram long, half long, after boolean, segment long, several boolean, before int, behind int, bytes binary"


def _pieces(rows: DataFrame, places: DataFrame) -> DataFrame:
    """The pieces at the places (_key, array of (at, gram, segment, several, after, half)), cut from the texts of rows(key, text)."""
    joined = _once_a_task(rows).join(places, F.col("key") == F.col("_key")).drop("_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in text_chunks(batches, CHUNK_BYTES):
            # Copies of a text follow each other.
            keys = batch.column("key").to_pylist()
            new = [k != before for k, before in zip(keys, [last, *keys])]
            last = keys[-1]
            batch = batch.filter(pa.array(new, pa.bool_()))
            if not batch.num_rows:
                continue
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            sizes = np.array([len(t) for t in texts], np.int64)
            data = np.frombuffer(b"".join([*texts, b"\xff"]), np.uint8)
            lists = batch.column("places")
            text = np.repeat(np.arange(len(texts)), np.diff(np.asarray(lists.offsets)))
            place = lists.flatten()
            at, after = np.asarray(place.field("at")).astype(np.int64), place.field("after").to_numpy(zero_copy_only=False)
            edge = np.cumsum(sizes) - sizes
            core = np.where(after, at, at - HALF)
            begin, end = core - HALF, core + GRAM + HALF
            offsets = np.arange(HALF)
            inside = np.c_[begin[:, None] + offsets, end[:, None] + offsets]
            outside = (inside < 0) | (inside >= sizes[text][:, None])
            cut = data[np.where(outside, len(data) - 1, inside + edge[text][:, None])]
            stride = np.arange(len(at) + 1, dtype=np.int32) * (2 * HALF)
            made = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(stride), pa.py_buffer(np.ascontiguousarray(cut))])
            columns = [place.field("gram"), place.field("half"), place.field("after"), place.field("segment"), place.field("several")]
            before, behind = np.clip(core, 0, HALF), np.clip(sizes[text] - end, 0, HALF)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(before.astype(np.int32)), pa.array(behind.astype(np.int32)), made], names=[x.split()[0] for x in PIECE.split(", ")])

    return small_batches(joined).mapInArrow(run, PIECE)


def _decided(pieces: DataFrame) -> DataFrame:
    """(gram, segment, lo, hi): the bytes around the anchor that repeated windows cover, by column-wise sorting in each task."""
    deal = ["gram", "half", "after"]
    dealt = pieces.repartition(*deal).sortWithinPartitions(*deal)
    kept = ["gram", "segment"]

    def solve(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        column = lambda name: rows.column(name).chunk(0).to_numpy(zero_copy_only=False)
        gram, half, after = (column(c) for c in deal)
        changed = (gram[1:] != gram[:-1]) | (half[1:] != half[:-1]) | (after[1:] != after[:-1])
        core = np.r_[0, np.cumsum(changed)].astype(np.int32)
        columns = Columns(2 * HALF)
        for batch in held:
            made = batch.column("bytes")
            columns.append(np.frombuffer(b"".join(made.to_pylist()), np.uint8).reshape(-1, 2 * HALF))
        least, most = repeated_windows(columns, core, column("before"), column("behind"), column("several"))
        columns.close()
        found = np.flatnonzero(most >= 0)
        start = np.where(after, 0, -HALF)[found]
        lo, hi = start - most[found], start - least[found] + WINDOW
        own = rows.select(kept).take(pa.array(found)).combine_chunks().to_batches()
        own = own[0].columns if own else [pa.array([], rows.schema.field(c).type) for c in kept]
        return pa.RecordBatch.from_arrays([*own, pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], names=[*kept, "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if size >= COLLECTION:
                # The rows of the core that goes on stay with it.
                same = np.ones(batch.num_rows, bool)
                for c in deal:
                    same &= batch.column(c).to_numpy(zero_copy_only=False) == held[-1].column(c)[-1].as_py()
                more = int(np.argmin(same)) if not same.all() else batch.num_rows
                if more:
                    held.append(batch.slice(0, more))
                    size += more
                    batch = batch.slice(more)
                if not batch.num_rows:
                    continue
                yield solve(held)
                held, size = [], 0
            held.append(batch)
            size += batch.num_rows
        if held:
            yield solve(held)

    return dealt.mapInArrow(run, "gram long, segment long, lo int, hi int")


def text_key() -> Column:
    return F.unhex(F.md5(F.col("text").cast("binary")))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(key, start, end) for the texts of docs(text): key is the MD5 of the text, the spans cover what is repeated.

    Rows with equal texts share a key; their spans are the same. Spans may come twice, and reach past the text's ends.
    """
    rows = docs.where(F.octet_length("text") >= WINDOW).select(text_key().alias("key"), "text")
    found = _anchor_rows(rows)
    # Written, so that Spark may split the rows of a frequent anchor in the join.
    twice = checkpointed(found.groupBy("gram").count().where("count > 1").select("gram"))
    occurring = checkpointed(found.join(twice, "gram"))
    classes = checkpointed(occurring.groupBy("gram", "segment").agg((F.count("*") > 1).alias("several"), F.min(F.struct("key", "at")).alias("one"), F.max("left").alias("left"), F.max("right").alias("right")))

    # Two different segments can only share a window if they share a half of it around the anchor.
    halves = F.array(*[F.struct(F.lit(after).alias("after"), F.col(c).alias("half")) for after, c in ((False, "left"), (True, "right"))])
    halves = classes.select("gram", "segment", "several", "one.key", "one.at", F.explode(halves).alias("h")).select("gram", "segment", "several", "key", "at", "h.after", "h.half").where("half <> 0")
    shared = halves.groupBy("gram", "after", "half").agg(F.count("*").alias("others")).where("others > 1")
    wanted = halves.join(shared, ["gram", "after", "half"], "left").where("several OR others IS NOT NULL").drop("others")
    places = wanted.groupBy(F.col("key").alias("_key")).agg(F.collect_list(F.struct("at", "gram", "segment", "several", "after", "half")).alias("places"))
    decided = checkpointed(_decided(_pieces(rows, checkpointed(places))))
    spread = decided.join(occurring.select("gram", "segment", "key", "at"), ["gram", "segment"])
    return spread.select("key", (F.col("at") + F.col("lo")).alias("start"), (F.col("at") + F.col("hi")).alias("end"))


def _with_spans(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with ``spans``, the repeated byte ranges of the text (may overlap)."""
    # Sets, not lists: each copy of a text names the same spans.
    spans = repeated_spans(docs).groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    rows = docs.withColumn("key", F.coalesce(text_key(), F.lit(b"")))
    return rows.join(spans.withColumnRenamed("key", "_key"), rows["key"] == F.col("_key"), "left").drop("key", "_key")


def kept_bytes(text: bytes, spans: list[dict] | None) -> tuple[bytes, list[tuple[int, int]]]:
    """The text without the spans, and the spans as maximal runs."""
    if not spans:
        return text, []
    runs = _merged(np.array([s["start"] for s in spans]), np.array([s["end"] for s in spans]))
    out, at = [], 0
    for a, b in runs:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]]), runs


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, kept (the remaining bytes), spans removed, n_bytes.

    Each byte that a repeated 200-byte string covers goes; strings are judged on the input, within
    documents. A null text counts as empty; null ids are kept; repeated rows repeat each other and
    lose all windows; texts under 200 bytes stay as they are; an empty table gives an empty result. A text is taken
    whole, in one task, with arrays of about 60 times its size while its anchors are found.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
            done = [kept_bytes(t, s) for t, s in zip(texts, batch.column("spans").to_pylist())]
            runs = pa.array([[{"start": a, "end": b} for a, b in r] for _, r in done], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([k for k, _ in done], pa.binary()), runs, pa.array([len(t) for t in texts], pa.int64())], names=["doc_id", "kept", "spans", "n_bytes"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return small_batches(_with_spans(rows)).mapInArrow(run, "doc_id long, kept binary, spans array<struct<start:int,end:int>>, n_bytes long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT r, i, md5(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT r, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM d WHERE length(h) >= 400)
), hit AS (
  SELECT r, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)
), runs AS (
  SELECT r, min(i) AS a, max(i) + 200 AS b FROM (
    SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS g FROM (
      SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM hit))
  GROUP BY r, g
), parts AS (
  SELECT r, a, b, substr(h, 2 * coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) + 1, 2 * (a - coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0))) AS x FROM runs JOIN d USING (r)
), kept AS (
  SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(x, '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS x FROM parts JOIN d USING (r) GROUP BY r
)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(x, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
