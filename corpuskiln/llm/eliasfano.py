"""Elias-Fano coded monotone sequences in 64-bit words, with vectorised access and search."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np

U = np.uint64


def _select_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th set bit, from 0."""
    at = np.zeros(len(word), np.int64)
    for s in (32, 16, 8, 4, 2, 1):
        low = word & U((1 << s) - 1)
        count = np.bitwise_count(low)
        up = k >= count
        k = k - np.where(up, count, 0)
        word = np.where(up, word >> U(s), low)
        at += np.where(up, s, 0)
    return at


@dataclass
class EliasFano:
    """values[i] = (number of zeros before the i-th one of ``high``) << bits | i-th of the packed ``low``.

    ones[w]: set bits of ``high`` before its word w.
    """

    size: int
    bits: int
    low: np.ndarray
    high: np.ndarray
    ones: np.ndarray

    @staticmethod
    def code(values: np.ndarray) -> "EliasFano":
        """values: int64, not negative, not decreasing."""
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        v = values.astype(np.uint64)
        low = np.zeros(n * bits // 64 + 2, np.uint64)
        if bits:
            part = v & U((1 << bits) - 1)
            at = np.arange(n, dtype=np.int64) * bits
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            np.bitwise_or.at(low, word, part << shift)
            over = np.flatnonzero((at & 63) + bits > 64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (U(64) - shift[over]))
        place = (v >> U(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(((top >> bits) + n) // 64 + 2, np.uint64)
        np.bitwise_or.at(high, place >> 6, U(1) << (place & 63).astype(np.uint64))
        ones = np.r_[0, np.cumsum(np.bitwise_count(high), dtype=np.int64)[:-1]]
        return EliasFano(n, bits, low, high, ones)

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.size, self.bits], np.uint64), self.low, self.high, self.ones.astype(np.uint64)]

    @staticmethod
    def of(arrays: list[np.ndarray]) -> "EliasFano":
        head, low, high, ones = arrays
        return EliasFano(int(head[0]), int(head[1]), low, high, ones.view(np.int64))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.int64)
        at = i * self.bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        # A shift by 64 is no shift in numpy, hence two.
        both = (self.low[word] >> shift) | ((self.low[word + 1] << U(1)) << (U(63) - shift))
        return (both & U((1 << self.bits) - 1)).astype(np.int64)

    def access(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, i, "right") - 1
        place = word * 64 + _select_in_word(self.high[word], i - self.ones[word])
        return ((place - i) << self.bits) | self._low(i)

    @cached_property
    def zeros(self) -> np.ndarray:
        """Clear bits of ``high`` before each of its words."""
        return np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones

    def _below(self, high: np.ndarray) -> np.ndarray:
        """How many values have a high part under ``high``."""
        out = np.zeros(len(high), np.int64)
        some = np.flatnonzero(high > 0)
        k = high[some] - 1
        zeros = self.zeros
        word = np.searchsorted(zeros, k, "right") - 1
        place = word * 64 + _select_in_word(~self.high[word], k - zeros[word])
        out[some] = np.minimum(place - k, self.size)
        return out

    def successor(self, x: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The least i in [begin, end) with values[i] >= x, else end."""
        high = x >> self.bits
        # Above the coded range there is nothing; the last word holds only zeros.
        inside = high < len(self.high) * 64 - 64 - self.size
        capped = np.where(inside, high, 0)
        low = x & ((1 << self.bits) - 1)
        a = np.clip(np.where(inside, self._below(capped), self.size), begin, end)
        b = np.clip(np.where(inside, self._below(capped + 1), self.size), begin, end)
        while (open_ := np.flatnonzero(a < b)).size:
            middle = (a[open_] + b[open_]) >> 1
            less = self._low(middle) < low[open_]
            a[open_[less]] = middle[less] + 1
            b[open_[~less]] = middle[~less]
        return a


def write(path: str, arrays: list[np.ndarray]) -> None:
    """The arrays, of 64-bit words, into one file; readers see the whole file or none."""
    import os
    import uuid

    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        np.array([len(arrays), *(len(a) for a in arrays)], np.uint64).tofile(f)
        for a in arrays:
            np.ascontiguousarray(a).view(np.uint64).tofile(f)
    os.replace(part, path)


def mapped(path: str) -> list[np.ndarray]:
    """The arrays of a file, memory-mapped."""
    words = np.memmap(path, np.uint64, "r")
    count = int(words[0])
    edge = 1 + count + np.r_[0, np.cumsum(words[1 : 1 + count].astype(np.int64))]
    return [words[a:b] for a, b in zip(edge[:-1], edge[1:])]
