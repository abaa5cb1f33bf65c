"""Incremental evaluation as Structured Streaming: resume, skip what is done, keep the summary current.

What is done, seen or summed lies in the state store, by key or by bucket of keys: a batch reads and writes the state of its own keys' buckets only. A stream with a checkpoint takes up where it stopped.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.evaluation import lane_counters, lane_metrics
from ..sources.snapshots import Snapshots, newest_by

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 24 * 60 * 60 * 1000
#: Keys are dealt to so many buckets, each of which has one value in the state store and is worked on at once: a key alone costs milliseconds.
#: Fixed for a checkpoint. The frames of a stream rename columns that begin with a line.
BUCKETS, HASHES = 1024, ["hash_1", "hash_2"]


def run_key(config: dict) -> str:
    """A hash of all settings of a run; results of other settings are never resumed."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()


def read_stream(spark: SparkSession, path: str, schema: str, fmt: str = "json", files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """A query started while this holds keeps its state in RocksDB, which state by key with timers and expiry needs."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def _firsts(rows: Iterator[pd.DataFrame], key: Sequence[str], order: str) -> pd.DataFrame | None:
    """The row of the lowest order of each key; of a frame that has been read no others are kept."""
    best, size = [], 0
    first = lambda frame: frame.sort_values(order, kind="stable").drop_duplicates(list(key))
    for frame in rows:
        if len(frame):
            best.append(first(frame))
        if sum(map(len, best)) > 2 * size + 10_000:
            best = [first(pd.concat(best))]
            size = len(best[0])
    return first(pd.concat(best)).reset_index(drop=True) if best else None


class _Once(StatefulProcessor):
    """Gives what ``work`` makes of the first rows of the keys of a bucket that are not done, and has those done that have no error.

    The bucket's state is one value: of each key that is done the 128 bits ``HASHES`` and until when. A key is forgotten when the watermark
    is ``keep_ms`` beyond the row that made it done; its bytes go when the bucket is next read, or when the bucket's timer ends, which is set
    for the last key known then.
    """

    def __init__(self, order: str, time: str, keep_ms: int, work: Callable[[pd.DataFrame], pd.DataFrame] | None = None, error: str = ""):
        self.order, self.time, self.keep_ms, self.work, self.error = order, time, keep_ms, work, error

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.done = handle.getValueState("done", "keys binary, timer bigint")

    def _known(self, watermark: int) -> tuple[np.ndarray, int]:
        """Rows of two hashes and a time, for the keys that are not forgotten, and for when the timer is set (0: none is)."""
        value = self.done.get()
        if value is None:
            return np.zeros((0, 3), np.int64), 0
        keys = np.frombuffer(value[0], np.int64).reshape(-1, 3)
        return keys[keys[:, 2] > watermark], value[1]

    def _keep(self, keys: np.ndarray, timer: int) -> None:
        if not len(keys) and not timer:
            return self.done.clear()
        if not timer:
            timer = int(keys[:, 2].max())
            self.handle.registerTimer(timer)
        self.done.update((keys.tobytes(), timer))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = _firsts(rows, HASHES, self.order)
        if first is None:
            return
        known, timer = self._known(timerValues.getCurrentWatermarkInMs())
        done = pd.MultiIndex.from_arrays([known[:, 0], known[:, 1]])
        fresh = first[~pd.MultiIndex.from_frame(first[HASHES]).isin(done)].reset_index(drop=True)
        if fresh.empty:
            return
        made = fresh.drop(columns=HASHES)
        if self.work:
            made = self.work(made)
            if not made.index.isin(fresh.index).all():
                raise ValueError("a result must have the index of the row that it was made of")
        if self.error in made:
            fresh = fresh.drop(index=made.index[made[self.error].fillna("").ne("")].unique())
        if len(fresh):
            until = pd.to_datetime(fresh[self.time]).to_numpy().astype("datetime64[ms]").astype(np.int64) + self.keep_ms
            self._keep(np.vstack([known, np.column_stack([fresh["hash_1"], fresh["hash_2"], until])]), timer)
        if len(made):
            yield made

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known, timer = self._known(timerValues.getCurrentWatermarkInMs())
        # A batch gives its rows first, so the timer that ended may be an older one.
        self._keep(known, 0 if timer <= expiredTimerInfo.getExpiryTimeInMs() else timer)
        return iter(())

    def close(self) -> None:
        pass


def _once(stream: DataFrame, hashed: Sequence[Column], processor: _Once, schema: str, delay_days: int) -> DataFrame:
    """What the processor gives for the stream, by buckets of keys."""
    keyed = stream.withColumn("hash_1", F.xxhash64(*hashed)).withColumn("hash_2", F.xxhash64(F.lit("second"), *hashed))
    keyed = keyed.withColumn("key_bucket", F.pmod("hash_1", F.lit(BUCKETS))).withWatermark(processor.time, f"{delay_days} days")
    return keyed.groupBy("key_bucket").transformWithStateInPandas(processor, schema, "append", "EventTime")


def resume(stream: DataFrame, run: str, key: Sequence[str], order: str, time: str, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str, out: str, checkpoint: str, error: str = "error", keep_days: int = 30) -> StreamingQuery:
    """Starts a query that works on the keys of the stream that are not done in ``run`` and appends the results, of ``schema``, to ``out``.

    Of a batch's rows of a key the one of the lowest ``order`` is taken; ``work`` gets a frame of such rows, one for each of many keys, and its
    results have the index of the row that they were made of. A result whose ``error`` is not empty
    is written, but its key is tried again when it next comes. A key stays done, in the state store under a hash of the run and the key, until the
    watermark, ``keep_days`` behind the latest ``time``, is as much beyond it; rows behind the watermark are dropped. Another run starts
    afresh. Results are written once, whatever is repeated after a failure. Stops when the input is used up.
    """
    # A null is hashed as nothing, so whether it is one is hashed, too.
    hashed = [F.lit(run), *[c for k in key for c in (F.col(k).isNull(), F.col(k))]]
    made = _once(stream, hashed, _Once(order, time, keep_days * DAY_MS, work, error), schema, keep_days)
    with keyed_state(stream.sparkSession):
        return made.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)


def first_seen(stream: DataFrame, text: str, order: str, time: str, delay_days: int = 1) -> DataFrame:
    """The first row of each text, whatever its case and white space: of the first batch that has it, the one of the lowest ``order``.

    State has 128 bits of hashes a text, not the text, and is bounded by the watermark, ``delay_days`` behind the latest time seen.
    A duplicate within that time after the first row is dropped; a row behind the watermark is dropped, be it a duplicate or not; a
    text that comes again later counts as new. To be started within ``keyed_state``.
    """
    plain = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    return _once(stream, [plain], _Once(order, time, delay_days * DAY_MS), stream.schema, delay_days)


# Running summary -----------------------------------------------------------------------------------------

#: Commits between two merges of the summary's table.
MERGE_EVERY = 16


def _cells(rows: DataFrame) -> DataFrame:
    """Counters by lane, and counts by lane and value: the order statistics that a median needs, a group for each value."""
    ok = F.coalesce(F.col("error"), F.lit("")) == ""
    cell = F.inline(F.array(F.struct(F.lit(False).alias("is_value"), F.lit(None).cast("double").alias("value")), F.struct(F.lit(True).alias("is_value"), F.when(ok, F.col("inference_seconds")).alias("value"))))
    return rows.select("*", cell).groupBy("language", "is_value", "value").agg(*[c.alias(k) for k, c in lane_counters().items()])


def _summary_table(spark: SparkSession, out: str) -> Snapshots:
    schema = _cells(spark.createDataFrame([], "language string, kind string, technical_pass boolean, format_compliant boolean, side_effect_free boolean, language_adherent boolean, inference_seconds double, completion_tokens long, error string")).schema
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    return Snapshots(spark, out, f"{columns}, batch long", newest_by(["language", "is_value", "value"], "batch"))


def running_summary(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Keeps the lanes' counters and value counts of all rows so far in the table ``out``.

    A batch gives only the groups that it changed, in update mode, and commits them once: its number marks the commit, so a batch that
    runs again adds nothing. Every ``MERGE_EVERY`` commits the newest row of each group is kept.
    """

    def handle(changed: DataFrame, batch: int) -> None:
        table = _summary_table(changed.sparkSession, out)
        table.append(changed.withColumn("batch", F.lit(batch).cast("long")), mark=str(batch))
        table.compact(MERGE_EVERY)

    return _cells(stream).writeStream.outputMode("update").foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_summary(spark: SparkSession, out: str) -> DataFrame:
    """The summary of each language as it stands, as ``evaluation.lane_summary`` gives it."""
    table = _summary_table(spark, out)
    cells = table.merge(table.read())
    lanes = cells.where("NOT is_value").drop("is_value", "value", "batch")
    wanted = lanes.select(F.col("language").alias("_l"), F.expr("(seconds_count + 1) div 2").alias("_r1"), F.expr("seconds_count div 2 + 1").alias("_r2"))
    upto = F.sum("seconds_count").over(W.partitionBy("language").orderBy("value"))
    values = cells.where("is_value AND value IS NOT NULL").select("language", "value", upto.alias("_upto"))
    reached = lambda r: F.min(F.when(F.col("_upto") >= F.col(r), F.col("value")))
    middle = values.join(wanted, F.col("language").eqNullSafe(F.col("_l"))).groupBy("_l").agg(((reached("_r1") + reached("_r2")) / 2).alias("median_inference_seconds"))
    return lane_metrics(lanes.join(middle, F.col("language").eqNullSafe(F.col("_l")), "left").drop("_l"))
