import json

import pytest

from pyspark.sql import functions as F

from corpuskiln.operators import evaluation
from corpuskiln.sources import readers, schemas, writers
from corpuskiln.streaming import incremental


def test_jsonl_round_trip(spark, tmp_path):
    path = tmp_path / "in.jsonl"
    path.write_text('{"source_id": "a", "language": "en", "messages": [{"role": "user", "content": "é"}]}\n\n', encoding="utf-8")
    df = readers.read_jsonl(spark, str(path), schemas.SFT_RECORD)
    assert df.count() == 1 and df.first().messages[0].content == "é" and df.first().variant is None
    writers.write_jsonl(df, str(tmp_path / "out"))
    text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "out").glob("part-*"))
    assert "é" in text and readers.read_jsonl(spark, str(tmp_path / "out"), schemas.SFT_RECORD).count() == 1


def test_documents_and_results(spark, tmp_path):
    for label in ("a", "b"):
        for part in ("en", "sw"):
            doc = {"schema": "v", "model": label, "results": [{"task_id": "t", "language": part, "technical_pass": True}], "summary": {"languages": {part: {"code_pass_rate": 0.5}}}}
            (tmp_path / f"{label}-{part}.json").write_text(json.dumps(doc, indent=1))
    docs = readers.read_labelled(spark, str(tmp_path), ["a", "b"], ["en", "sw"], schemas.EVALUATION)
    got = {(r.label, r.part, r.m) for r in docs.select("label", "part", evaluation.metric(F.struct("summary"), "en", "code_pass_rate", required=False).alias("m")).collect()}
    assert got == {("a", "en", 0.5), ("b", "en", 0.5), ("a", "sw", None), ("b", "sw", None)}
    assert readers.results_of(docs, "label").count() == 4
    assert readers.read_glob(spark, str(tmp_path), "a-*.json", schemas.EVALUATION).count() == 2


def test_documents_are_written_pretty(spark, tmp_path):
    writers.write_document(spark.createDataFrame([(True, 1)], "passed boolean, n int"), str(tmp_path / "doc"))
    text = "".join(p.read_text() for p in (tmp_path / "doc").glob("part-*"))
    assert json.loads(text) == {"passed": True, "n": 1} and '\n  "passed"' in text


def test_logs(spark):
    lines = spark.createDataFrame([("[13/50] he_1 en",), ("  PASS | 68.0s",), ("noise",), ("[01/50] fence_01 FAIL",)], "value string")
    got = {tuple(r) for r in readers.parse_progress(lines).collect()}
    assert got == {(13, 50, "he_1", "en", None, None), (None, None, None, None, True, 68.0), (1, 50, "fence_01", None, False, None)}


def test_sources(spark, tmp_path):
    (tmp_path / "a.py").write_bytes(b"x = '\xff'")
    (tmp_path / "b.py").write_bytes(b"y" * 100)
    with pytest.raises(Exception, match="more than 50 bytes"):
        readers.read_source_files(spark, str(tmp_path), most=50).collect()
    got = readers.read_source_files(spark, str(tmp_path), most=50, skip_larger=True).collect()
    assert len(got) == 1 and got[0].code.startswith("x = '")
    assert readers.literal_table(spark, [("a",), ("b",)], "k string").collect()[1].ordinal == 1
    probes = readers.format_probes(spark, 20, 15, 15, ["en", "sw", "mix"])
    assert probes.count() == 50 and probes.where("ordinal = 1").first().id == "format_fence_01"


def test_cache_appends_misses_only(spark, tmp_path):
    path = str(tmp_path / "cache")
    spark.createDataFrame([("a", "1")], "k string, v string").write.parquet(path)
    new = spark.createDataFrame([("a", "2"), ("b", "3")], "k string, v string")
    for _ in range(2):
        writers.append_to_cache(new, spark.read.parquet(path), "k", "v", path)
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [("a", "1"), ("b", "3")]


def test_blocks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "o int, t string")
    writers.write_blocks(df, "t", ["o"], str(tmp_path / "t"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "t").glob("part-*"))).split() == ["a", "b"]


def test_run_key():
    assert incremental.run_key({"a": 1, "b": 2}) == incremental.run_key({"b": 2, "a": 1}) != incremental.run_key({"a": 1, "b": 3})
