"""Queries that come about in several runs: streams with keyed state, and tables that change by commits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import shared_folder
from ..sources.snapshots import Cache
from ..streaming import incremental
from .catalogue import KEY, SQL, query, results, t


def _tried(job: pd.DataFrame) -> pd.DataFrame:
    """What a run makes of a job: jobs of low value end in an error."""
    return job.assign(passed=job["value"] > 30, error=["timeout" if v < 8 else "" for v in job["value"]])[["user_id", "event_type", "event_id", "passed", "error"]]


@query("""
WITH e AS (SELECT user_id, event_type, event_id, value, event_id % 3 AS run FROM events),
j0 AS (SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM e WHERE run = 0 GROUP BY ALL),
d0 AS (SELECT user_id, event_type FROM j0 WHERE NOT value < 8),
j1 AS (SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM e ANTI JOIN d0 USING (user_id, event_type) WHERE run = 1 GROUP BY ALL),
d1 AS (SELECT * FROM d0 UNION SELECT user_id, event_type FROM j1 WHERE NOT value < 8),
j2 AS (SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM e ANTI JOIN d1 USING (user_id, event_type) WHERE run = 2 GROUP BY ALL)
SELECT user_id, event_type, event_id, value > 30 AS passed, CASE WHEN value < 8 THEN 'timeout' ELSE '' END AS error FROM (SELECT * FROM j0 UNION ALL SELECT * FROM j1 UNION ALL SELECT * FROM j2)
""")
def resumed_results(spark, d):
    """Jobs that arrive in three runs: each works only on keys that are not done, and again on those that ended in an error."""
    folder, key = shared_folder(spark), ["user_id", "event_type"]
    events = t(spark, d, "events").select(*key, "event_id", "value").withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("event_id") % 3600))
    schema = events.limit(0).schema
    run = incremental.run_key({"model": "m", "languages": ["en"]})
    for k in range(3):
        events.where(F.col("event_id") % 3 == k).write.mode("append").parquet(f"{folder}/in")
        stream = incremental.read_stream(spark, f"{folder}/in", schema, "parquet")
        made = "user_id bigint, event_type string, event_id bigint, passed boolean, error string"
        incremental.resume(stream, run, key, "event_id", "at", _tried, made, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.schema(made).parquet(f"{folder}/out")


@query(SQL["lane_summary"])
def running_summary(spark, d):
    """The lanes' summary as it stands after results came in three runs."""
    folder = shared_folder(spark)
    rows = results(spark, d).drop("text", "task_id")
    schema = rows.limit(0).schema
    for k in range(3):
        rows.where(F.col("doc_id") % 3 == k).write.mode("append").parquet(f"{folder}/in")
        incremental.running_summary(incremental.read_stream(spark, f"{folder}/in", schema, "parquet"), f"{folder}/out", f"{folder}/state").awaitTermination()
    return incremental.current_summary(spark, f"{folder}/out")


@query(f"SELECT min(doc_id) AS doc_id, {KEY} AS dedup_key FROM documents GROUP BY ALL")
def seen_keys(spark, d):
    """The first document of each text, of two halves that arrive one after the other, an hour after each other's start."""
    folder = shared_folder(spark)
    docs = t(spark, d, "documents").select("doc_id", "text").withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") % 3600))
    middle = docs.agg(F.avg("doc_id")).first()[0] or 0
    for late in (False, True):
        docs.where((F.col("doc_id") >= middle) == late).write.mode("append").parquet(f"{folder}/in")
        stream = incremental.read_stream(spark, f"{folder}/in", docs.schema, "parquet")
        with incremental.keyed_state(spark):
            first = incremental.first_seen(stream, "text", "doc_id", "at").writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
        first.awaitTermination()
    return spark.read.schema(docs.schema).parquet(f"{folder}/out").select("doc_id", X.dedup_key(F.col("text")).alias("dedup_key"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 < 3 THEN length(text) END AS size FROM documents")
def cache_cycle(spark, d):
    """A cache that is filled twice, merged and looked up; three of four texts are in it."""
    docs = t(spark, d, "documents").select("doc_id", "text")
    keyed = docs.withColumn("key", F.concat(X.sha256(F.col("text")), F.lit(":"), F.pmod("doc_id", F.lit(4)).cast("string")))
    cache = Cache(spark, shared_folder(spark), "key", "size", "key string, size long", buckets=16)
    values = keyed.select("key", "doc_id", F.length("text").cast("long").alias("size"))
    cache.append(values.where("doc_id % 4 = 0"))
    cache.append(values.where("doc_id % 4 < 3"))
    cache.compact()
    return cache.lookup(keyed.select("doc_id", "key")).select("doc_id", "size")
