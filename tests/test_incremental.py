"""Streams with keyed state, tables that change by commits, and exact medians."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from corpuskiln.operators import evaluation, selection
from corpuskiln.sources import files
from corpuskiln.sources.snapshots import Cache, Snapshots, newest_by
from corpuskiln.streaming import incremental

SCHEMA = "task string, language string, value int, at timestamp"
DAY = 86_400


def test_resume_works_on_new_and_failed_keys_only(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    worked = "task string, language string, value int, error string"

    def work(job):
        return job.assign(error=["bad" if v < 0 else "" for v in job["value"]])[["task", "language", "value", "error"]]

    def go(run, *rows):
        if rows:
            spark.createDataFrame([(k, "en", v, day) for k, v, day in rows], "task string, language string, value int, day long").select("task", "language", "value", F.timestamp_seconds(1_700_000_000 + DAY * F.col("day")).alias("at")).coalesce(1).write.mode("append").json(source)
        incremental.resume(incremental.read_stream(spark, source, SCHEMA), run, ["task", "language"], "value", "at", work, worked, out, state, keep_days=2).awaitTermination()
        return sorted((r.task, r.value, r.error) for r in spark.read.schema(worked).parquet(out).collect())

    one = go("r", ("a", 1, 0), ("b", -1, 0), ("a", 0, 0))
    assert one == [("a", 0, ""), ("b", -1, "bad")]
    two = go("r", ("a", 7, 0), ("b", 5, 0), ("c", 3, 0))
    assert two == sorted([*one, ("b", 5, ""), ("c", 3, "")])
    assert go("r") == two
    # A row far ahead moves the watermark; the keys behind it are forgotten, and rows behind it are dropped.
    three = go("r", ("d", 1, 10))
    four = go("r", ("a", 9, 10), ("e", 1, 0))
    assert set(four) - set(three) == {("a", 9, "")}


def test_running_summary_adds_a_batch_once(spark, tmp_path):
    table = Snapshots(spark, str(tmp_path / "t"), "k string, v int, o int", newest_by(["k"], "o"))
    rows = lambda *x: spark.createDataFrame(list(x), "k string, v int, o int")
    assert table.read().count() == 0 and table.append(rows(("a", 1, 1), ("b", 2, 1)), "1") and not table.append(rows(("a", 9, 9)), "1")
    assert table.append(rows(("a", 3, 2)), "2") and table.version().number == 2
    assert sorted(tuple(r) for r in table.read(1).collect()) == [("a", 1, 1), ("b", 2, 1)]
    assert table.compact() and not table.compact()
    assert sorted(tuple(r) for r in table.read().collect()) == [("a", 3, 2), ("b", 2, 1)] and not table.append(rows(("x", 1, 1)), "2")
    assert table.vacuum(1) == 2 and table.read().count() == 2
    with pytest.raises(ValueError):
        table.read(99)
    with pytest.raises(files.FileExists):
        table._commit(table.version())


def test_files_appear_whole(spark, tmp_path):
    path = f"{tmp_path}/a.json"
    for text in ("one", "zwei é"):
        files.write_text(spark, path, text)
        assert files.read_text(spark, path) == text
    with pytest.raises(files.FileExists):
        files.write_text(spark, path, "three", overwrite=False)
    assert files.read_text(spark, path) == "zwei é" and [n for n in files.names(spark, str(tmp_path)) if not n.startswith(".")] == ["a.json"]


def test_cache_is_joined_where_it_lies(spark, tmp_path):
    cache = Cache(spark, str(tmp_path / "c"), "k", "v", "k string, v int", buckets=4)
    pairs = lambda *x: spark.createDataFrame(list(x), "k string, v int")
    cache.append(pairs(("a", 1), ("b", 2), (None, 5)))
    cache.append(pairs(("a", 7), ("c", 3), ("c", 4)))
    asked = spark.createDataFrame([("a",), ("c",), ("z",), (None,)], "k string")
    want = {("a", 1), ("c", 3), ("z", None), (None, None)}
    for _ in range(2):
        found = cache.lookup(asked)
        assert {tuple(r) for r in found.collect()} == want
        plan = found._jdf.queryExecution().executedPlan().toString()
        scan = plan[plan.index("SortMergeJoin") :] if "SortMergeJoin" in plan else plan
        assert "Bucketed: true" in scan and scan.count("Exchange hashpartitioning") <= 1 + scan.count("Initial Plan")
        cache.compact()
    assert Cache(spark, str(tmp_path / "c"), "k", "v", "k string, v int", buckets=4).rows().count() == 3


@pytest.mark.parametrize("few", [1, 7, 10_000])
def test_medians_by_sorting(spark, few):
    rng = random.Random(few)
    rows = [(rng.choice(["a", "b", "b", "b", None]), rng.choice([-1.5, 0.0, 2.0, rng.gauss(0, 5), rng.random() * 1e6, None])) for _ in range(400)] + [("one", 3.0), ("none", None), *[("same", 4.0)] * 30]
    got = {r.lane: r.m for r in selection.medians(spark.createDataFrame(rows, "lane string, v double").repartition(3), F.col("v"), ["lane"], "m", few=few).collect()}
    want = {}
    for lane in {x for x, _ in rows}:
        if values := [v for x, v in rows if x == lane and v is not None]:
            want[lane] = statistics.median(values)
    assert got == want


def test_medians_of_the_whole(spark):
    df = spark.range(1001).select((F.col("id") * 0.5).alias("v"))
    assert selection.medians(df, F.col("v"), [], few=10).first()["median"] == 250.0
    assert evaluation.telemetry(df.withColumn("m", F.lit(1.0)).limit(0), "v", "m").first().median_tps is None


def test_keys_are_worked_on_by_buckets(spark, tmp_path, monkeypatch):
    """A key alone costs milliseconds: work gets the first rows of many keys at once, and state has a value for a bucket."""
    monkeypatch.setattr(incremental, "BUCKETS", 8, raising=False)
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    keys = [(a, b) for a in [None, *map(str, range(99))] for b in (None, "0")]

    def go(low):
        rows = [(a, b, v, "t" if a is None else a, i % 7) for i, (a, b) in enumerate(keys) for v in (low + 1, low)]
        spark.createDataFrame(rows, "a string, b string, v int, text string, day long").select("a", "b", "v", "text", F.timestamp_seconds(1_700_000_000 + F.col("day")).alias("at")).coalesce(1).write.mode("append").parquet(source)
        stream = incremental.read_stream(spark, source, "a string, b string, v int, text string, at timestamp", "parquet")
        work = lambda job: job.assign(n=len(job), error=["bad" if v == 0 and b is None else "" for v, b in zip(job["v"], job["b"])])[["a", "b", "v", "n", "error"]]
        made = "a string, b string, v int, n int, error string"
        query = incremental.resume(stream, "r", ["a", "b"], "v", "at", work, made, out, state)
        query.awaitTermination()
        return spark.read.schema(made).parquet(out).collect()

    one = go(0)
    assert sorted(map(str, one)) and {(r.a, r.b) for r in one} == set(keys) and len(one) == len(keys) and {r.v for r in one} == {0}
    assert max(r.n for r in one) > 1
    two = go(5)[:]
    again = [(r.a, r.b, r.v) for r in two if r.v]
    assert sorted(again, key=str) == sorted([(a, b, 5) for a, b in keys if b is None], key=str)


def test_first_texts_have_state_by_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental, "BUCKETS", 8, raising=False)
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema, sizes = "k int, text string, at timestamp", []
    for start in (0, 100):
        rows = [(start + i, f"Text  {(start + i) % 150}" if i % 2 else f"text {(start + i) % 150}") for i in range(100)]
        spark.createDataFrame(rows, "k int, text string").withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000))).coalesce(1).write.mode("append").parquet(source)
        with incremental.keyed_state(spark):
            query = incremental.first_seen(incremental.read_stream(spark, source, schema, "parquet"), "text", "k", "at").writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
        query.awaitTermination()
        sizes.append(max(o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]))
    assert sorted(r.k for r in spark.read.schema(schema).parquet(out).collect()) == list(range(150))
    assert max(sizes) <= 4 * 8
