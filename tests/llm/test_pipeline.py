import json
import re
from pathlib import Path

import corpus_pipeline
from pyspark.sql import functions as F

from corpuskiln.llm import decontamination, near_copies, quality, queries, secrets, sharding, simhash, suffixes


def write_tables(spark, folder, docs, labels, items):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages_take_effect(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frames[-1], sf)
        if name != "sentencepiece":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(len(frames))))
        frames.append(spark.read.parquet(str(tmp_path / str(len(frames)))))
    counts = [f.count() for f in frames]
    assert counts == sorted(counts, reverse=True) and counts[0] > counts[1] > counts[2] > counts[3] == counts[4] == counts[5]
    assert frames[2].select("text").distinct().count() == counts[2]
    assert frames[5].where("NOT round_trip").count() == 0
    assert {r.doc_id for r in frames[4].collect()} == {r.doc_id for r in frames[5].collect()}


def test_run_on_edges(spark, edge, edge_rows, tmp_path):
    write_tables(spark, tmp_path / "a", edge, [(i, i % 2, 0) for i in range(6)], [(1, "no such words in any of them")])
    got = corpus_pipeline.run(spark, str(tmp_path / "a"))
    assert 0 < got.count() <= len(edge_rows) and "ids" in got.columns
    write_tables(spark, tmp_path / "b", edge.limit(0), [], [])
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).count() == 0


def test_every_operator_has_its_query():
    assert [q.split("_")[0] for q in queries.QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_nothing_else_imports_the_subpackage():
    root = Path(corpus_pipeline.__file__).parent
    for path in (root / "corpuskiln").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"(import|from)\b.*\bllm\b", path.read_text(encoding="utf-8")), path
    assert json.dumps(len(corpus_pipeline.STAGES)) == "5"


def test_columns_of_any_name_stay(spark, edge, edge_rows):
    """Extra columns with the names that the stages use inside, on rows that are repeated, null or empty."""
    names = ["_kept_id", "_kept_text", "_bad_id", "_bad_text", "_id", "_row", "_text", "_at", "shard", "slot", "held_out", "set_key", "root", "words", "_copy", "w", "n"]
    docs = edge.select("doc_id", "text", "lang", "source", "n_chars", *[F.lit(c).alias(c) for c in names])
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, quality int")
    items = spark.createDataFrame([(1, "no such words in any of them"), (2, None)], "item_id long, text string")
    for out in (quality.keep_good(docs, labels, threshold=0.0), near_copies.keep_one(docs), simhash.keep_one(docs), decontamination.remove_contaminated(docs, items), secrets.redact(docs)):
        rows = out.collect()
        assert out.columns == docs.columns and 0 < len(rows) <= len(edge_rows)
        assert all(r[c] == c for r in rows for c in names)
    for f in (simhash.groups, near_copies.groups, secrets.find_secrets, suffixes.remove_repeats, lambda d: sharding.shard_rows(d, 3), lambda d: decontamination.contamination(d, items)):
        assert f(docs).count() == len(edge_rows)


def test_the_row_that_stays_is_defined(spark):
    rows = [(1, "a b c", "z"), (1, "a b c", "y"), (1, "a b c", "y"), (2, "A b c", "a")]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, x string").repartition(2)
        assert [tuple(r) for r in near_copies.keep_one(docs).collect()] == [(1, "a b c", "y")]
