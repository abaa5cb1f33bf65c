"""A quality classifier: random-indexing word vectors, pooled, and a small calibrated network.

1. Every token has a sparse random index vector, given by its hash. A word's vector is the sum of
   the index vectors of the tokens around its occurrences, over all documents: partitions sum in
   numpy, Spark adds up the cells with map-side aggregation. Words share ``BUCKETS`` rows by hash, so the matrix
   (BUCKETS x DIM, 1 MB) does not grow with the corpus and may be collected and broadcast.
2. A document is the mean and the deviation of its words' unit vectors, with its length and the shares of
   words that are repeated or repeat the one before.
3. A two-layer network is trained in numpy on at most ``SAMPLE`` labelled documents, chosen by
   hash; its temperature is fitted on a part of them that is kept back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bytes_of, free_name, small_batches, table, text_chunks
from .tokens import mixed, tokenize

BUCKETS, DIM, NONZERO, WINDOW = 8192, 32, 2, 2
#: Labelled documents that the network is trained on, at most.
SAMPLE = 20_000
HIDDEN, EPOCHS, BATCH, RATE = 32, 40, 64, 3e-3
THRESHOLD = 0.3


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(BUCKETS)).astype(np.int64)


def _contexts(texts: list[bytes], total: np.ndarray) -> None:
    """Adds the index vectors of the tokens around each token to its bucket's row."""
    tokens = tokenize(texts, punctuation=True)
    if len(tokens.hashes) < 2:
        return
    text, row = tokens.text_of(), _buckets(tokens.hashes) * DIM
    for k in range(NONZERO):
        h = mixed(tokens.hashes + np.uint64(k + 1))
        place, sign = (h % np.uint64(DIM)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)
        for d in range(1, WINDOW + 1):
            same = text[d:] == text[:-d]
            for word, other in ((slice(None, -d), slice(d, None)), (slice(d, None), slice(None, -d))):
                total += np.bincount((row[word] + place[other])[same], sign[other][same], BUCKETS * DIM)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The unit vectors of the buckets, from all rows of docs(text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS * DIM)
        for batch in text_chunks(batches):
            _contexts(bytes_of(batch), total)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(total[cell].astype(np.int64))], names=["cell", "n"])

    cells = small_batches(docs.select("text")).mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    vectors = np.zeros(BUCKETS * DIM)
    vectors[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    vectors = vectors.reshape(BUCKETS, DIM)
    return (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).astype(np.float32)


FEATURES = 2 * DIM + 4


def features(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """A row per text; zeros for a text without tokens."""
    tokens = tokenize(texts, punctuation=True)
    out = np.zeros((len(texts), FEATURES))
    some = np.flatnonzero(tokens.counts)
    if len(some):
        n = tokens.counts[some]
        start = np.cumsum(n) - n
        own = vectors[_buckets(tokens.hashes)]
        mean = np.add.reduceat(own, start, axis=0) / n[:, None]
        square = np.add.reduceat(own * own, start, axis=0) / n[:, None]
        out[some, :DIM] = mean
        out[some, DIM : 2 * DIM] = np.sqrt(np.maximum(square - mean * mean, 0))
        text = tokens.text_of()
        order = np.lexsort((tokens.hashes, text))
        h, t = tokens.hashes[order], text[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (t[1:] != t[:-1])]
        distinct = np.bincount(t[new], minlength=len(texts))[some]
        again = (tokens.hashes[1:] == tokens.hashes[:-1]) & (text[1:] == text[:-1])
        out[some, 2 * DIM + 3] = np.bincount(text[1:][again], minlength=len(texts))[some] / n
        out[some, 2 * DIM] = distinct / n
        out[some, 2 * DIM + 1] = np.log1p(n)
        out[some, 2 * DIM + 2] = np.log1p(np.array([len(x) for x in texts])[some]) - np.log1p(n)
    return out


@dataclass
class Network:
    """score = sigmoid((relu((x - mean) / scale @ w1 + b1) @ w2 + b2) / temperature)"""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Network:
    """Fits the network. With fewer than 20 rows, or rows of one label only, one that scores every text with the share of label 1 (0.5 if none)."""
    if len(y) < 20 or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
        return Network(np.zeros(FEATURES), np.ones(FEATURES), np.zeros((FEATURES, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))
    rng = np.random.Generator(np.random.PCG64(seed))
    order = rng.permutation(len(y))
    held, used = order[: len(y) // 5], order[len(y) // 5 :]
    mean, scale = x[used].mean(0), x[used].std(0) + 1e-3
    z, t = (x[used] - mean) / scale, y[used]
    p = [rng.normal(0, np.sqrt(2 / FEATURES), (FEATURES, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(2 / HIDDEN), HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(EPOCHS):
        mixed_order = rng.permutation(len(t))
        for at in range(0, len(t), BATCH):
            b = mixed_order[at : at + BATCH]
            hidden = np.maximum(z[b] @ p[0] + p[1], 0)
            error = (1 / (1 + np.exp(-np.clip(hidden @ p[2] + p[3], -40, 40))) - t[b]) / len(b)
            back = np.outer(error, p[2]) * (hidden > 0)
            grads = [z[b].T @ back + 1e-4 * p[0], back.sum(0), hidden.T @ error + 1e-4 * p[2], np.array([error.sum()])]
            step += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    made = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]))
    logit, t = made.logits(x[held]), y[held]
    choices = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
    made.temperature = float(min(choices, key=lambda c: np.mean(np.logaddexp(0, logit / c) - t * logit / c)))
    return made


def held_out(doc_id: Column, fold: int = 0) -> Column:
    """Whether crc32 of the id as text leaves the remainder ``fold`` by 5; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("long").cast("string").cast("binary")), F.lit(5)) == fold, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, Network]:
    """Word vectors from all docs, and the network from the labels outside the held-out fold.

    Ids that carry both labels, or none, are left out; ids on several documents train with each.
    """
    vectors = word_vectors(docs)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("quality").alias("y"), F.max("quality").alias("_y")).where("y = _y").drop("_y")
    # A documented bound: the ids of the lowest hashes.
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            x = features(bytes_of(batch), vectors).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("y"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES).cast(pa.list_(pa.float32()))], names=["id", "y", "x"])

    rows = docs.join(F.broadcast(known), docs["doc_id"].cast("long") == known["_id"]).select("_id", "y", "text")
    # Ids may be on several documents; the bound holds for the rows that come back too.
    got = small_batches(rows).mapInArrow(run, "id long, y int, x array<float>").orderBy(F.xxhash64("id"), "id", "x").limit(sample).toArrow()
    x = np.array(got.column("x").to_pylist(), np.float64).reshape(-1, FEATURES)
    return vectors, train(x, np.array(got.column("y").to_pylist(), np.float64))


def scored(docs: DataFrame, vectors: np.ndarray, network: Network, name: str = "_score") -> DataFrame:
    """The rows of docs, all columns, with ``name``: the probability of label 1. A null text is scored as an empty one; no rows give none."""
    schema = docs.withColumn(name, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            yield batch.append_column(name, pa.array(network.score(features(bytes_of(batch), vectors))))

    return small_batches(docs).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, held_out, score, predicted (1 if score >= threshold).

    Only the text is an input of a score. A null text counts as empty and gets the score of a text
    without words; null ids are kept; repeated rows each get a row; without labels the score is 0.5.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    vectors, network = fit(rows, labels.select("doc_id", "quality"))
    found = scored(rows, vectors, network)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that the classifier does not reject.

    A null text is scored as an empty one, a null id keeps its row, repeated rows are kept or rejected together; ``threshold`` itself is kept.
    """
    vectors, network = fit(docs.select("doc_id", "text"), labels.select("doc_id", "quality"))
    name = free_name(docs, "_score")
    return scored(docs, vectors, network, name).where(F.col(name) >= threshold).drop(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))
