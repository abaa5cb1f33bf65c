"""Token counts with overlap resynchronisation for huge documents.

A byte-level BPE tokenizer first cuts a text into pretokens and then merges inside each.
White space that follows anything but white space always starts a pretoken, whatever stands
before or after it; a cut there is *stable*: both sides are encoded as they would be together.

* Huge texts are encoded in overlapping chunks with offsets. Two neighbouring encodings are
  spliced at a stable place where both start a token; without one the overlap is widened, and
  when it would reach the chunk's own start the chunk itself is.
* Shorter texts go through the same encoder unit by unit, a unit being what lies between two
  stable places. A unit's count is remembered by the worker, so each distinct unit is encoded
  about once per task.
* Texts with white space outside tab, newline, return and space, where units are not proven
  independent, are encoded as a whole (in chunks when huge).
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import small_batches, table, text_chunks, texts_of

UNIT = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
#: White space to some regex engine that UNIT does not cut at.
OTHER_SPACE = re.compile(r"[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
STABLE = re.compile(r"(?<=[^\s\u180e\u200b-\u200d\u2060\ufeff])[ \t\n\r]")

HUGE_CHARS = 32_768
CHUNK_CHARS = 16_384
OVERLAP_CHARS = 256
MEMO_ENTRIES = 400_000
LIMIT_TOKENS = 1024


def load_tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _starts(tokenizer, text: str, at: int) -> np.ndarray:
    """Offsets in the document at which the tokens of this chunk start."""
    offsets = tokenizer.encode(text, add_special_tokens=False).offsets
    return np.fromiter((a for a, _ in offsets), np.int64, len(offsets)) + at


def count_spliced(tokenizer, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    """Tokens of a text that is encoded in overlapping chunks of bounded length.

    ``left`` holds token starts of the current chunk from ``done`` on, the last splice.
    """
    total, done, start = 0, 0, 0
    end = min(len(text), chunk)
    left = _starts(tokenizer, text[:end], 0)
    while end < len(text):
        width, size = overlap, chunk
        while True:
            begin = max(end - width, done)
            stop = min(len(text), max(end + size - width, end + 1))
            right = _starts(tokenizer, text[begin:stop], begin)
            stable = [p for m in STABLE.finditer(text, begin, end) if (p := m.start()) > begin]
            common = np.intersect1d(np.intersect1d(left, right), np.asarray(stable, np.int64))
            if len(common):
                break
            if begin > done:
                width *= 4
                continue
            # The whole chunk has no stable place: replace it by one that reaches further.
            end, left = stop, right
            if end == len(text):
                return total + int((left >= done).sum())
            size *= 2
        splice = int(common[len(common) // 2])
        total += int(((left >= done) & (left < splice)).sum())
        done, start, end, left = splice, begin, stop, right
    return total + int((left >= done).sum())


class Counter:
    """Counts tokens as the tokenizer does, remembering the counts of units."""

    def __init__(self, path: str, huge: int = HUGE_CHARS, memo_entries: int = MEMO_ENTRIES):
        self.tokenizer, self.huge, self.memo_entries = load_tokenizer(path), huge, memo_entries
        self.memo: dict[str, int] = {}

    def counts(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        units: list[list[str] | None] = [None] * len(texts)
        for i, text in enumerate(texts):
            if len(text) > self.huge:
                out[i] = count_spliced(self.tokenizer, text)
            elif OTHER_SPACE.search(text):
                out[i] = len(self.tokenizer.encode(text, add_special_tokens=False).ids)
            else:
                units[i] = UNIT.findall(text)
        wanted = set().union(*(u for u in units if u))
        if len(self.memo) + len(wanted) > self.memo_entries:
            self.memo.clear()
        if new := [u for u in wanted if u not in self.memo]:
            encoded = self.tokenizer.encode_batch_fast(new, add_special_tokens=False)
            self.memo.update(zip(new, (len(e.ids) for e in encoded)))
        get = self.memo.__getitem__
        for i, own in enumerate(units):
            if own is not None:
                out[i] = sum(map(get, own))
        return out


SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT_TOKENS) -> DataFrame:
    """Per row of docs(doc_id, text): n_bytes, n_tokens and whether the tokens exceed ``limit``.

    A null text counts as empty (0 tokens); a null doc_id is kept; repeated rows each get a row;
    an empty table gives an empty result; other columns are not looked at. There is no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(tokenizer_path)
        for batch in text_chunks(batches):
            n = np.asarray(counter.counts(texts_of(batch)), np.int64)
            size = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return small_batches(docs.select(docs["doc_id"].cast("long"), docs["text"])).mapInArrow(run, SCHEMA)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), default_tokenizer())
