"""Tokens of many texts at once, as numpy arrays of byte positions and 64-bit hashes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

MIX = np.uint64(0xFF51AFD7ED558CCD)
_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
BYTE_VALUE.flags.writeable = False
BASE = np.uint64(0x9E3779B97F4A7C55)

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


@dataclass
class Tokens:
    """hashes: of the tokens in order; counts: how many tokens each text has."""

    hashes: np.ndarray
    counts: np.ndarray

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * MIX
    return h ^ (h >> np.uint64(29))


def hash_runs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A polynomial hash of each data[start:end]; runs are in order and do not overlap."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    power = np.cumprod(np.full(int(size.max()), BASE, np.uint64))
    values = BYTE_VALUE[data[np.repeat(start, size) + inside]] * power[inside]
    return mixed(np.add.reduceat(values, np.cumsum(size) - size) + size.astype(np.uint64))


def tokenize(texts: list[bytes], punctuation: bool = False) -> Tokens:
    """Tokens of the texts with A-Z in lower case.

    Runs of bytes other than white space; with ``punctuation``, runs of letters, digits and
    non-ASCII bytes, and every other byte but white space alone.
    """
    data = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
    if punctuation:
        word = WORD_BYTE[data]
        single = ~word & ~WHITE[data]
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        ends = word[:-1] & ~word[1:]
        start = np.flatnonzero(begins | single)
        end = np.where(single[start], start + 1, 0)
        end[~single[start]] = np.flatnonzero(ends) + 1
    else:
        word = ~WHITE[data]
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        start = np.flatnonzero(begins)
        end = np.flatnonzero(word[:-1] & ~word[1:]) + 1
    edge = np.r_[0, np.cumsum([len(t) + 1 for t in texts])]
    counts = np.diff(np.searchsorted(start, edge))
    return Tokens(hash_runs(data, start, end), counts)
