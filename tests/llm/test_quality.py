import re
import numpy as np
from pyspark.sql import functions as F

from corpuskiln.llm import quality
from corpuskiln.llm.tokens import tokenize


def test_tokens():
    t = tokenize([b"Ab  c\nab", b"", b"x"])
    assert list(t.counts) == [3, 0, 1] and t.hashes[0] == t.hashes[2] != t.hashes[1]
    t = tokenize(["aé1,, b".encode(), b"--"], punctuation=True)
    assert list(t.counts) == [4, 2] and t.hashes[1] == t.hashes[2]


def test_vectors_do_not_depend_on_partitions(edge):
    a, b = quality.word_vectors(edge.repartition(1)), quality.word_vectors(edge.repartition(5))
    assert np.allclose(a, b)


def test_network_learns_and_is_calibrated():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, quality.FEATURES))
    p = 1 / (1 + np.exp(-2 * x[:, 0] + x[:, 1] * x[:, 2]))
    y = (rng.random(2000) < p).astype(float)
    got = quality.train(x[:1500], y[:1500]).score(x[1500:])
    assert np.mean((got > 0.5) == (p[1500:] > 0.5)) > 0.75
    assert abs(got.mean() - y[1500:].mean()) < 0.08


def test_edges(spark, edge, edge_rows, empty):
    labels = spark.createDataFrame([(i, i % 2, 0, "x") for i in range(10)] + [(None, 1, 0, "x"), (3, None, 1, "x")], "doc_id long, quality int, toxic int, key string")
    for lab in (labels, labels.limit(0)):
        got = quality.classify(edge, lab).collect()
        assert len(got) == len(edge_rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out is not None for r in got)
    assert quality.classify(empty, labels).count() == 0
    assert quality.keep_good(edge, labels).columns == edge.columns


def test_held_out_accuracy(spark, sf):
    folder = sf.replace("sf0.001", "sf0.1")
    got = quality.query(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out")
    r = got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("a"), F.count_if(F.expr("predicted = 0 AND quality = 1")).alias("lost"), F.count_if(F.expr("predicted = 0 AND quality = 0")).alias("hit"), F.count_if(F.expr("quality = 0")).alias("bad")).first()
    assert r.a > 0.97 and r.lost <= 4 and r.hit > 0.85 * r.bad


def test_labels_of_the_held_out_fold_do_not_count(spark, edge):
    ids = [r.doc_id for r in edge.select("doc_id").distinct().where("doc_id IS NOT NULL").collect()]
    a = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    b = a.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    score = lambda lab: sorted((repr(r.doc_id), r.score) for r in quality.classify(edge, lab).collect())
    assert score(a) == score(b)


TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\x20\x09-\x0d]")


def hash_of(token):
    return int(quality.tokenize([token], punctuation=True).hashes[0])


def mixed(h):
    return int(quality.mixed(np.array([h % (1 << 64)], np.uint64))[0])


def brute_vectors(texts):
    total = np.zeros((quality.BUCKETS, quality.DIM))
    for t in texts:
        tokens = [hash_of(x) for x in TOKEN.findall((t or "").encode().lower())]
        for i, word in enumerate(tokens):
            for j in range(max(0, i - quality.WINDOW), min(len(tokens), i + quality.WINDOW + 1)):
                if j != i:
                    for k in range(quality.NONZERO):
                        h = mixed(tokens[j] + k + 1)
                        total[word % quality.BUCKETS, h % quality.DIM] += 1 if h >> 63 else -1
    return total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)


def brute_features(text, vectors):
    data = (text or "").encode()
    tokens = [hash_of(x) for x in TOKEN.findall(data.lower())]
    if not tokens:
        return np.zeros(quality.FEATURES)
    own = np.array([vectors[h % quality.BUCKETS] for h in tokens])
    n = len(tokens)
    counts = [len(set(tokens)) / n, np.log1p(n), np.log1p(len(data)) - np.log1p(n), sum(a == b for a, b in zip(tokens, tokens[1:])) / n]
    return np.r_[own.mean(0), own.std(0), counts]


def test_vectors_features_and_scores_match_brute_force(spark, edge, edge_rows):
    texts = [r[1] for r in edge_rows]
    vectors = quality.word_vectors(edge)
    want = brute_vectors(texts)
    assert np.abs(vectors - want).max() < 1e-5
    x = np.array([brute_features(t, want) for t in texts])
    assert np.abs(quality.features([(t or "").encode() for t in texts], vectors) - x).max() < 1e-4
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    fitted, network = quality.fit(edge.select("doc_id", "text"), labels)
    got = sorted((r.score for r in quality.classify(edge, labels).collect()))
    assert np.allclose(got, sorted(network.score(x)), atol=1e-3) and (fitted == vectors).all()
