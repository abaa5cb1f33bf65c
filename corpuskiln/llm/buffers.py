"""Texts as the bytes that Arrow holds them in: classes of bytes, counts by prefix sums, and words as places."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that a prefix sum covers at once.
BLOCK = 4 << 20


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the places where its texts begin, with the end after them. Null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = column.type in (pa.large_string(), pa.large_binary())
    _, places, data = column.buffers()
    edge = np.frombuffer(places, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    size = int(edge[-1] - edge[0])
    return (np.frombuffer(data, np.uint8, size, int(edge[0])) if size else np.zeros(0, np.uint8)), edge - edge[0]


def class_table(members: bytes) -> np.ndarray:
    """Which of the 256 bytes are members."""
    table = np.zeros(256, bool)
    table[np.frombuffer(members, np.uint8)] = True
    return table


def counts_in(data: np.ndarray, edge: np.ndarray, table: np.ndarray) -> np.ndarray:
    """How many bytes of each text belong to the class: differences of prefix sums, taken block by block."""
    sums, total, at = np.zeros(len(edge), np.int64), 0, 0
    for begin in range(0, len(data), BLOCK):
        part = np.cumsum(table[data[begin : begin + BLOCK]], dtype=np.int64)
        end = int(np.searchsorted(edge, begin + len(part), "right"))
        inside = edge[at:end] - begin
        sums[at:end] = total + np.where(inside > 0, part[np.maximum(inside, 1) - 1], 0)
        total, at = total + int(part[-1]), end
    sums[at:] = total
    return np.diff(sums)


def words_in(data: np.ndarray, edge: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words, runs of bytes of the class within a text, begin and end, and how many each text has."""
    inside = table[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    # Texts lie side by side: a word ends with its text.
    borders = edge[1:-1]
    borders = borders[(borders > 0) & (borders < len(data))]
    begins[borders] = inside[borders]
    ends[borders - 1] = inside[borders - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.diff(np.searchsorted(start, edge))
