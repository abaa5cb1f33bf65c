"""Secret scans: all rules in one pass of a combined deterministic automaton.

The rules' expressions are reversed and compiled into one automaton; a pass over the bytes, from the end, gives every place
where some rule's match begins, and which rules'. From a place that is not inside the rule's match before, an automaton
for matches that begin there runs to the last byte at which it accepts: the leftmost, longest matches, which for these rules are what a
backtracking matcher gives. No regular-expression library takes part. No rule matches across a newline, so texts are scanned joined by newlines.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import automaton
from .common import bytes_of, small_batches, table, text_chunks


@dataclass(frozen=True)
class Rule:
    """kind; expression; the least length of a match that counts, or with ``tail`` of its last run of one class.

    A match that is too short does not count, but what it covers begins no other match of the rule. After the first byte
    at which an expression with ``tail`` accepts only its last run follows.
    """

    kind: str
    pattern: str
    least: int
    tail: bool = False


#: The first three are the base rules; spans are ordered by start, then as listed here.
RULES = (
    Rule("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+", 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]{16,}", 16),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("webtoken", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30),
    Rule("keyblock", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0),
)
BASE = ("assign", "access", "hex")


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.starts = automaton.build([r.pattern for r in rules], backwards=True)
        ahead = automaton.build([r.pattern for r in rules], anchored=True)
        self.step, self.class_of, self.dead = ahead.step.tolist(), ahead.class_of.tolist(), ahead.dead
        self.masks, self.classes = ahead.masks.tolist(), ahead.classes

    def match(self, data: bytes, at: int, rule: int) -> tuple[int, int]:
        """(end of the rule's longest match that begins at ``at``, end of its shortest)."""
        state, end, shortest = 0, -1, -1
        while at < len(data):
            state = self.step[state + self.class_of[data[at]]]
            if state == self.dead:
                break
            at += 1
            if self.masks[state // self.classes] >> rule & 1:
                end = at
                if shortest < 0:
                    shortest = at
        return end, shortest

    def matches(self, data: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, rule number, end) in bytes of data, of what the rules accept."""
        places, masks = automaton.scan(self.starts, data[::-1])
        if not len(places):
            return []
        places, masks = len(data) - 1 - places[::-1], masks[::-1]
        out, whole = [], data.tobytes()
        for k, rule in enumerate(self.rules):
            starts = places[(masks >> k & 1).astype(bool)].tolist()
            i = 0
            while i < len(starts):
                end, shortest = self.match(whole, starts[i], k)
                if end - (shortest - 1 if rule.tail else starts[i]) >= rule.least:
                    out.append((starts[i], k, end))
                i = bisect_left(starts, end, i + 1)
        return sorted(out)

    def spans(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """For each UTF-8 text its (start, rule number, end) in code points, in order."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        found = self.matches(data)
        if not found:
            return out
        text_at = np.r_[0, np.cumsum([len(t) + 1 for t in texts])]
        points = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
        text = np.searchsorted(text_at, [s for s, _, _ in found], "right") - 1
        for (s, k, e), r in zip(found, text):
            before = points[text_at[r]]
            out[r].append((int(points[s] - before), k, int(points[e] - before)))
        return out


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    return Scanner(rules)


def written(spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    return ",".join(f"{rules[k].kind}:{s}:{e}" for s, k, e in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row of docs(doc_id, text): counts of the base kinds, digest of the base spans, all spans.

    Offsets are code points, ends exclusive. A null text counts as empty: no spans; a null doc_id
    is kept; repeated rows each get a row; spans of different kinds may overlap, those of one kind
    do not; an empty table gives an empty result. A text is scanned whole, with some 30 times its size in arrays.
    There is no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scanner(rules)
        for batch in text_chunks(batches):
            found = own.spans(bytes_of(batch))
            base = [[x for x in f if rules[x[1]].kind in BASE] for f in found]
            counts = [pa.array([sum(rules[k].kind == kind for _, k, _ in b) for b in base], pa.int64()) for kind in BASE]
            digests = [hashlib.sha256(written(b, rules).encode()).hexdigest() for b in base]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array(digests, pa.string()), pa.array([written(f, rules) for f in found], pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return small_batches(docs.select(docs["doc_id"].cast("long"), docs["text"])).mapInArrow(run, SCHEMA)


def redacted(text: str, spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    """The text with each span, overlapping ones merged, replaced by the first one's kind in brackets."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"[{rules[k].kind}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs, all columns, with secrets in ``text`` replaced and ``n_chars``, if there, made right.

    A null text stays null; texts without a secret stay as they are.
    """
    schema, has_size = docs.schema, "n_chars" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scanner(rules)
        for batch in text_chunks(batches):
            texts = batch.column("text").to_pylist()
            found = own.spans(bytes_of(batch))
            if any(found):
                new = [redacted(t, f, rules) if f else t for t, f in zip(texts, found)]
                batch = batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(new, batch.schema.field("text").type))
                if has_size:
                    old = batch.column("n_chars")
                    sizes = [len(t) if f else o for t, f, o in zip(new, found, old.to_pylist())]
                    batch = batch.set_column(batch.schema.get_field_index("n_chars"), "n_chars", pa.array(sizes, old.type))
            yield batch

    return small_batches(docs).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents", "doc_id", "text"))
