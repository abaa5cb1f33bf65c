"""Glossaries that are tables: all their phrases are looked up in one pass over a text, whatever their number.

Phrases and texts are cut into words and what stands between them. Each run of a text's pieces that is as long as some phrase is looked up in a
bitmap of fixed size, which is broadcast; the runs found there meet the phrases in an equi-join, so that work grows with the texts and the
phrases and not with their product. A text's occurrences are then chosen from by place and declared order, as one pass of alternatives would.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import small_batches

#: Phrases that the bitmap, of 2,048 bits for each of so many, tells from nearly all else; of more phrases, more runs go to the join in vain.
PART_PHRASES = 50_000
_BASE = np.uint64(0x9E3779B97F4A7C55)

_PIECE = re.compile(r"\w+|\W")


def _pieces(text: str) -> list[str]:
    """Words, and every other character alone."""
    return _PIECE.findall(text)


@lru_cache(maxsize=1 << 17)
def _number(piece: str) -> int:
    return int.from_bytes(blake2b(piece.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _slots(lower: list[str], size: int, bits: int) -> np.ndarray:
    """The bit of each run of so many pieces."""
    numbers = np.array([_number(p) for p in lower], np.uint64)
    if len(numbers) < size:
        return np.zeros(0, np.int64)
    h = np.zeros(len(numbers) - size + 1, np.uint64)
    for k in range(size):
        h = (h + numbers[k : len(numbers) - size + 1 + k]) * _BASE
        h ^= h >> np.uint64(29)
    return (h % np.uint64(bits)).astype(np.int64)


def _joined(lower: list[str]) -> str:
    """The pieces as one string that no other pieces give."""
    return "\0".join(lower)


def chosen(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of occurrences those that a scan from the left takes: at the leftmost place the lowest ordinal, then on behind its end."""
    out, free = [], 0
    for begin, end, ordinal in sorted(found, key=lambda x: (x[0], x[2])):
        if begin >= free:
            out.append((begin, end, ordinal))
            free = end
    return out


def _keyed(glossary: DataFrame, bits: int) -> DataFrame:
    """(run, size, slot, ordinal) of the glossary's phrases; of equal ones, whatever their case, the first counts."""
    phrases = glossary.where("phrase IS NOT NULL AND length(trim(phrase)) > 0").select(F.col("ordinal").cast("long").alias("ordinal"), "phrase")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = [_pieces(x.lower()) for x in batch.column(1).to_pylist()]
            rows = [[_joined(p) for p in pieces], [len(p) for p in pieces], [int(_slots(p, len(p), bits)[0]) for p in pieces]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(r, k) for r, k in zip(rows, (pa.string(), pa.int64(), pa.int64()))]], names=["ordinal", "run", "size", "slot"])

    return phrases.mapInArrow(run, "ordinal long, run string, size long, slot long").groupBy("run").agg(F.min("ordinal").alias("ordinal"), F.first("size").alias("size"), F.first("slot").alias("slot"))


def occurrences(texts: DataFrame, glossary: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ordinal, begins, ends) of every phrase of glossary(ordinal, phrase) in texts, any case, at word edges, overlapping ones too.

    A row per text and phrase, with all places where it begins and ends, in characters. Only which numbers of pieces phrases have, and the words of the
    bitmap that are not zero, are collected.
    """
    bits = PART_PHRASES << 11
    keyed = _keyed(glossary, bits)
    words = keyed.groupBy("size", F.expr("slot div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, CAST(slot % 64 AS INT)))").alias("bits"))
    found = words.toArrow()
    sizes = sorted(set(found.column("size").to_pylist()))
    bitmap = np.zeros(bits // 64, np.int64)
    np.bitwise_or.at(bitmap, found.column("w").to_numpy(), found.column("bits").to_numpy())
    shared = texts.sparkSession.sparkContext.broadcast(bitmap)

    def runs(text: str) -> dict[str, list[tuple[int, int]]]:
        pieces = _pieces(text)
        lower = [p.lower() for p in pieces]
        ends = np.cumsum([0, *map(len, pieces)])
        out: dict[str, list[tuple[int, int]]] = {}
        for size in sizes:
            slots = _slots(lower, size, bits)
            for i in np.flatnonzero(shared.value[slots >> 6] >> (slots & 63) & 1).tolist():
                out.setdefault(_joined(lower[i : i + size]), []).append((int(ends[i]), int(ends[i + size])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, r, places) for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if x for r, places in runs(x).items()]
            places = [[p[k] for p in r[2]] for k in (0, 1) for r in rows]
            columns = [pa.array([r[0] for r in rows], batch.column(0).type), pa.array([r[1] for r in rows], pa.string()), *[pa.array(x, pa.list_(pa.int64())) for x in (places[: len(rows)], places[len(rows) :])]]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "run", "begins", "ends"])

    kind = texts.schema[key].dataType.simpleString()
    made = small_batches(texts).select(key, text).mapInArrow(run, f"`{key}` {kind}, run string, begins array<long>, ends array<long>")
    return made.join(keyed.select("run", "ordinal"), "run").select(key, "ordinal", "begins", "ends")


def _put(text: str | None, hits: list | None) -> str | None:
    if text is None or not hits:
        return text
    out, at = [], 0
    for h in sorted(hits, key=lambda h: h["begin"]):
        out += [text[at : h["begin"]], h["value"]]
        at = h["end"]
    return "".join([*out, text[at:]])


def substituted(texts: DataFrame, glossary: DataFrame, key: str, text: str, name: str = "replaced") -> DataFrame:
    """(key, name, hits): the text with each chosen phrase of glossary(ordinal, phrase, value) replaced, and the phrases hit, in glossary order.

    Phrases are taken from the left; where several begin at one place, the one of the lowest ordinal. Values are not looked at again, a
    null value is empty. The key must be unique. A text without phrases stays as it is, null stays null. Occurrences of a text meet in one row.
    """
    spans = "array<struct<begin: long, end: long, ordinal: long>>"
    pick = F.udf(lambda o: [dict(zip(("begin", "end", "ordinal"), x)) for x in chosen([(a, b, x["ordinal"]) for x in o for a, b in zip(x["begins"], x["ends"])])], spans, useArrow=True)
    put = F.udf(_put, "string", useArrow=True)
    found = occurrences(texts, glossary, key, text).groupBy(key).agg(F.collect_list(F.struct("ordinal", "begins", "ends")).alias("o"))
    values = glossary.select(F.col("ordinal").cast("long").alias("ordinal"), "phrase", F.coalesce("value", F.lit("")).alias("value"))
    # Only what is chosen meets the values: a row per hit.
    hits = found.select(key, F.explode(pick("o")).alias("h")).select(key, "h.*").join(values, "ordinal")
    hits = hits.groupBy(F.col(key).alias("_k")).agg(F.collect_list(F.struct("begin", "end", "value")).alias("h"), F.array_sort(F.collect_set(F.struct("ordinal", "phrase"))).alias("p"))
    joined = texts.select(key, text).join(hits, F.col(key) == F.col("_k"), "left")
    phrases = F.coalesce(F.transform("p", lambda x: x["phrase"]), F.array().cast("array<string>"))
    return joined.select(key, put(text, "h").alias(name), phrases.alias("hits"))
