"""SentencePiece encoding and decoding in numpy batches.

A text is cut where no piece can cross: before each run of spaces, and around newlines when these
are unknown to the model. The distinct words so found are encoded together, all of one length at a
time, and stay encoded for the rest of a task; substring hashes probe the sorted hashes of the pieces.

* A model of the unigram type takes the segmentation with the highest total score, by Viterbi: for
  each start the words advance through the substring lengths, and vectorised maxima keep scores
  and backpointers.
* A model of the BPE type is defined by its merges, which no sum of scores reproduces. Its words
  advance together merge by merge: each takes its best pair, found by a vectorised maximum.

A character without a piece of its own is encoded as the byte pieces of its UTF-8.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, text_chunks

SPACE = "▁"
MULTIPLIER, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
INVERSE = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
PREFIX_BITS = 20
MEMO_WORDS = 300_000
CHUNK = 6 << 20
#: Longer words are cut where no piece crosses; parts that are longer still are merged one by one.
LONG_WORD = 128
#: Characters of a long word that are looked at together.
BLOCK = 1 << 18


def code_points(words: list[str]) -> np.ndarray:
    """The code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)


def prefix_hashes(points: np.ndarray) -> np.ndarray:
    """Column j: the hash of the first j code points; hash of [i, j) is H[j] - H[i] * M ** (j - i)."""
    words, length = points.shape
    out = np.zeros((words, length + 1), np.uint64)
    if length > 64 * words:
        # A few long rows: H[j] is M ** (j - 1) times a running sum, modulo 2 ** 64, where M has an inverse.
        one = np.ones(min(length, 1), np.uint64)
        power, back = (np.cumprod(np.r_[one, np.full(max(length - 1, 0), m, np.uint64)]) for m in (MULTIPLIER, INVERSE))
        out[:, 1:] = np.cumsum((points.astype(np.uint64) + np.uint64(1)) * SPREAD * back, axis=1) * power
        return out
    for j in range(length):
        out[:, j + 1] = out[:, j] * MULTIPLIER + (points[:, j].astype(np.uint64) + np.uint64(1)) * SPREAD
    return out


@dataclass
class Pieces:
    """The pieces that can occur in a segmentation, by sorted hash, and the tables for probing and decoding."""

    keys: np.ndarray
    ids: np.ndarray
    scores: np.ndarray
    prefixes: np.ndarray
    longest: int
    unknown_score: float
    byte_ids: list[int]
    decoded: list[bytes]
    newline_known: bool
    merges: bool

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Where in the sorted keys the hashes are; -1 if they are not."""
        at = np.searchsorted(self.keys, hashes)
        at[at == len(self.keys)] = 0
        at[self.keys[at] != hashes] = -1
        return at


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    model = SentencePieceProcessor(model_file=path)
    proto = sentencepiece_model_pb2.ModelProto.FromString(model.serialized_model_proto())
    spec = proto.normalizer_spec
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not (spec.add_dummy_prefix and spec.escape_whitespaces):
        raise ValueError(f"{path} asks for a normalisation that is not supported")
    merges = proto.trainer_spec.model_type == proto.trainer_spec.BPE
    texts, ids, scores, byte_ids, decoded = [], [], [], [0] * 256, []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            decoded.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            decoded.append(b"")
        else:
            decoded.append(piece.replace(SPACE, " ").encode())
            if SPACE in piece.lstrip(SPACE):
                raise ValueError(f"piece {piece!r} crosses words")
            texts.append(piece)
            ids.append(i)
            scores.append(model.get_score(i))
    if not any(byte_ids):
        raise ValueError(f"{path} has no byte pieces")
    keys, prefixes = np.zeros(len(texts), np.uint64), np.zeros(1 << PREFIX_BITS, bool)
    sizes = np.array([len(t) for t in texts])
    for n in np.unique(sizes):
        which = np.flatnonzero(sizes == n)
        made = prefix_hashes(code_points([texts[i] for i in which]))
        keys[which] = made[:, -1]
        prefixes[(made[:, 1:] >> np.uint64(64 - PREFIX_BITS)).ravel()] = True
    order = np.argsort(keys)
    if (np.diff(keys[order]) == 0).any():
        raise ValueError("two pieces have one hash")
    return Pieces(keys[order], np.array(ids, np.int32)[order], np.array(scores)[order], prefixes, int(sizes.max()), min(scores) - 10, byte_ids, decoded, "\n" in texts, merges)


def merged(points: np.ndarray, p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """The rows' pieces after merging, again and again, a row's best pair (the leftmost of equal ones), and how many each row has."""
    words, length = points.shape
    hashes = prefix_hashes(points)
    powers = np.cumprod(np.full(p.longest + 1, MULTIPLIER, np.uint64))

    def score(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.full(len(row), -np.inf)
        short = np.flatnonzero(end - start <= p.longest)
        row, start, end = row[short], start[short], end[short]
        sub = hashes[row, end] - hashes[row, start] * powers[end - start - 1]
        likely = np.flatnonzero(p.prefixes[sub >> np.uint64(64 - PREFIX_BITS)])
        at = p.find(sub[likely])
        out[short[likely[at >= 0]]] = p.scores[at[at >= 0]]
        return out

    # Of the symbol that starts at i: ends[i], before[i] is where the symbol before it starts, pair[i] scores it with the next.
    ends = np.tile(np.arange(1, length + 1), (words, 1))
    before = np.tile(np.arange(-1, length), (words, 1))
    alive = np.ones((words, length), bool)
    pair = np.full((words, length), -np.inf)
    if length > 1:
        row, start = np.divmod(np.arange(words * (length - 1)), length - 1)
        pair[:, : length - 1] = score(row, start, start + 2).reshape(words, -1)
    rows = np.arange(words)
    while len(rows):
        i = pair[rows].argmax(1)
        going = pair[rows, i] > -np.inf
        rows, i = rows[going], i[going]
        j = ends[rows, i]
        end = ends[rows, j]
        ends[rows, i], alive[rows, j], pair[rows, j], before[rows, end] = end, False, -np.inf, i
        more = end < length
        pair[rows, i] = -np.inf
        pair[rows[more], i[more]] = score(rows[more], i[more], ends[rows[more], end[more]])
        left = before[rows, i]
        has = left >= 0
        pair[rows[has], left[has]] = score(rows[has], left[has], end[has])
    row, start = np.nonzero(alive)
    return _ids(p, points, hashes, powers, row, start, ends[row, start], words)


def _ids(p: Pieces, points: np.ndarray, hashes: np.ndarray, powers: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    at = p.find(hashes[row, end] - hashes[row, start] * powers[end - start - 1])
    return np.where(at >= 0, p.ids[at], -1 - points[row, start].astype(np.int64)), np.bincount(row, minlength=words)


def merged_long(points: np.ndarray, p: Pieces) -> np.ndarray:
    """As ``merged`` for one long word, with a heap of pairs instead of a maximum over all."""
    length = points.shape[1]
    hashes = prefix_hashes(points)
    powers = np.cumprod(np.full(p.longest + 1, MULTIPLIER, np.uint64))
    # Scores of all substrings of up to the longest piece's length that are pieces.
    scores: dict[tuple[int, int], float] = {}
    for n in range(2, min(p.longest, length) + 1):
        at = p.find(hashes[0, n:] - hashes[0, : length + 1 - n] * powers[n - 1])
        scores.update({(int(i), int(i) + n): float(p.scores[at[i]]) for i in np.flatnonzero(at >= 0)})
    ends, before, alive = list(range(1, length + 1)), list(range(-1, length)), [True] * length
    heap = [(-s, i, e, i + 1) for (i, e), s in scores.items() if e - i == 2]
    heapq.heapify(heap)
    while heap:
        _, i, end, j = heapq.heappop(heap)
        if not (alive[i] and ends[i] == j and j < length and alive[j] and ends[j] == end):
            continue
        ends[i], alive[j] = end, False
        if end < length:
            before[end] = i
            if (s := scores.get((i, ends[end]))) is not None:
                heapq.heappush(heap, (-s, i, ends[end], end))
        if before[i] >= 0 and (s := scores.get((before[i], end))) is not None:
            heapq.heappush(heap, (-s, before[i], end, i))
    start = np.flatnonzero(alive)
    return _ids(p, points, hashes, powers, np.zeros(len(start), np.int64), start, np.array(ends)[start], 1)[0]


def apart(points: np.ndarray, p: Pieces) -> np.ndarray:
    """The places of one long word that no piece of it crosses, so that no merge does: what lies between two is merged on its own.

    Every merge makes a piece, so a place inside no occurrence of one stays a border. Found block by block, in memory that does not grow
    with the word but for a mark per character.
    """
    length = points.shape[1]
    crossed = np.zeros(length + 1, np.int32)
    powers = np.cumprod(np.full(p.longest + 1, MULTIPLIER, np.uint64))
    for begin in range(0, length, BLOCK):
        hashes = prefix_hashes(points[:, begin : begin + BLOCK + p.longest])[0]
        for n in range(2, min(p.longest, len(hashes) - 1) + 1):
            sub = hashes[n:][:BLOCK] - hashes[:-n][:BLOCK] * powers[n - 1]
            likely = np.flatnonzero(p.prefixes[sub >> np.uint64(64 - PREFIX_BITS)])
            at = begin + likely[p.find(sub[likely]) >= 0]
            # One piece of a length begins at a place, so places are distinct.
            crossed[at + 1] += 1
            crossed[at + n] -= 1
    return np.flatnonzero(np.cumsum(crossed)[1:length] == 0) + 1


def viterbi(points: np.ndarray, p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """The best segmentation of each row: all piece ids, with -1 - code point for an unknown character, and how many each row has."""
    words, length = points.shape
    hashes = prefix_hashes(points)
    powers = np.cumprod(np.full(p.longest + 1, MULTIPLIER, np.uint64))
    best = np.full((words, length + 1), -np.inf)
    best[:, 0] = 0
    back = np.zeros((words, length + 1), np.int32)
    chosen = np.zeros((words, length + 1), np.int64)
    for i in range(length):
        rows = np.arange(words)
        known = np.zeros(words, bool)
        for n in range(1, min(p.longest, length - i) + 1):
            sub = hashes[rows, i + n] - hashes[rows, i] * powers[n - 1]
            alive = p.prefixes[sub >> np.uint64(64 - PREFIX_BITS)]
            rows, sub = rows[alive], sub[alive]
            if not len(rows):
                break
            at = np.searchsorted(p.keys, sub)
            at[at == len(p.keys)] = 0
            found = p.keys[at] == sub
            hit, at = rows[found], at[found]
            if n == 1:
                known[hit] = True
            score = best[hit, i] + p.scores[at]
            better = score > best[hit, i + n]
            hit, at = hit[better], at[better]
            best[hit, i + n], back[hit, i + n], chosen[hit, i + n] = score[better], i, p.ids[at]
        lost = np.flatnonzero(~known)
        score = best[lost, i] + p.unknown_score
        lost, score = lost[score > best[lost, i + 1]], score[score > best[lost, i + 1]]
        best[lost, i + 1], back[lost, i + 1], chosen[lost, i + 1] = score, i, -1 - points[lost, i].astype(np.int64)
    taken = np.zeros((words, length), bool)
    at = np.full(words, length)
    while (going := np.flatnonzero(at > 0)).size:
        taken[going, at[going] - 1] = True
        at[going] = back[going, at[going]]
    return chosen[:, 1:][taken], taken.sum(1)


class Codec:
    """Encodes with the method of the model's type, or with the one asked for ("viterbi" or "merges")."""

    def __init__(self, path: str, method: str | None = None, memo_words: int = MEMO_WORDS):
        self.pieces, self.memo_words = load(path), memo_words
        self.method = method or ("merges" if self.pieces.merges else "viterbi")
        self.memo: dict[str, bytes] = {}
        self.unit = re.compile(" +[^ ]*|[^ ]+" if self.pieces.newline_known else "\n| +[^ \n]*|[^ \n]+")

    def _learn(self, words: list[str]) -> None:
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        for length, own in by_length.items():
            step = max(1, (1 << 18) // length)
            for k in range(0, len(own), step):
                part = own[k : k + step]
                points = code_points([w.replace(" ", SPACE) for w in part])
                if self.method == "viterbi":
                    ids, counts = viterbi(points, self.pieces)
                elif length > LONG_WORD:
                    found = [self._long(points[i : i + 1]) for i in range(len(points))]
                    ids, counts = np.concatenate(found), np.array([len(x) for x in found])
                else:
                    ids, counts = merged(points, self.pieces)
                ids, counts = self._as_bytes(ids, counts)
                # All words' ids are one string of bytes, of which each gets its part.
                data, end = ids.astype("<i4").tobytes(), (4 * np.cumsum(counts)).tolist()
                self.memo.update(zip(part, [data[a:b] for a, b in zip([0, *end], end)]))

    def _as_bytes(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unknown characters as the pieces of their bytes."""
        unknown = np.flatnonzero(ids < 0)
        if not len(unknown):
            return ids, counts
        spelled = [[self.pieces.byte_ids[b] for b in chr(-1 - i).encode()] for i in ids[unknown].tolist()]
        size = np.ones(len(ids), np.int64)
        size[unknown] = [len(x) for x in spelled]
        out = np.repeat(ids, size)
        out[np.repeat(ids < 0, size)] = [x for s in spelled for x in s]
        word = np.repeat(np.arange(len(counts)), counts)
        return out, np.bincount(word, size, len(counts)).astype(np.int64)

    def _long(self, points: np.ndarray) -> np.ndarray:
        """A long word in the parts that no piece crosses: those of equal length are merged together, what is still long alone."""
        length = points.shape[1]
        edge = np.r_[0, apart(points, self.pieces), length]
        size = np.diff(edge)
        ids: list[np.ndarray | None] = [None] * len(size)
        for n in np.unique(size):
            same = np.flatnonzero(size == n)
            if n > LONG_WORD:
                for k in same:
                    ids[k] = merged_long(points[:, edge[k] : edge[k + 1]], self.pieces)
                continue
            for at in range(0, len(same), max(1, BLOCK // int(n))):
                part = same[at : at + max(1, BLOCK // int(n))]
                found, counts = merged(points[0][edge[part][:, None] + np.arange(n)], self.pieces)
                for k, x in zip(part, np.split(found, np.cumsum(counts)[:-1])):
                    ids[k] = x
        return np.concatenate(ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The piece ids of each text as little-endian 32-bit integers."""
        units = [self.unit.findall(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
        wanted = set().union(*units)
        new = wanted - self.memo.keys()
        if len(self.memo) + len(new) > self.memo_words:
            self.memo.clear()
            new = wanted
        self._learn(list(new))
        get = self.memo.__getitem__
        return [b"".join(map(get, u)) for u in units]

    def decode(self, ids: np.ndarray) -> str:
        """The text of piece ids; ids of control pieces and outside the model give nothing."""
        table = self.pieces.decoded
        text = b"".join([table[i] for i in ids.tolist() if 0 <= i < len(table)]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def _id_lists(encoded: list[bytes]) -> pa.Array:
    offsets = np.r_[0, np.cumsum([len(e) // 4 for e in encoded])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(encoded), "<i4")))


def encode(docs: DataFrame, model_path: str, check: bool = False) -> DataFrame:
    """docs(doc_id, text) with ``ids``; with ``check`` also ``decoded``, the text got back from the ids.

    A null or empty text has no ids and decodes to the empty text. The input character U+2581
    stands for a space, as in the library, so it decodes to one. A null doc_id is kept; repeated
    rows each get a row; other columns are not looked at. There is no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model_path)
        for batch in text_chunks(batches, CHUNK):
            encoded = codec.encode([t or "" for t in batch.column("text").to_pylist()])
            columns, names = [batch.column("doc_id"), batch.column("text"), _id_lists(encoded)], ["doc_id", "text", "ids"]
            if check:
                columns.append(pa.array([codec.decode(np.frombuffer(e, "<i4")) for e in encoded], pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, "doc_id long, text string, ids array<int>" + ", decoded string" * check)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """encoded(doc_id, ids) to (doc_id, text); null ids give a null text, none the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model_path)
        for batch in batches:
            texts = [None if x is None else codec.decode(np.array([i for i in x if i is not None], np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return small_batches(encoded.select("doc_id", "ids")).mapInArrow(run, "doc_id long, text string")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def digests(encoded: DataFrame, *more: str) -> DataFrame:
    """What the query returns of checked encodings: counts, a hash of the ids, and whether the text came back; and ``more`` columns."""
    text = F.coalesce("text", F.lit(""))
    return encoded.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), (F.col("decoded") == F.translate(text, SPACE, " ")).alias("round_trip"), *more)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode(table(spark, sf_dir, "documents", "doc_id", "text"), default_model(), check=True))
