"""Session construction with the settings the plans of this package rely on."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Whether shuffle files go when the statement that wrote them ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that Python gets at once where rows are whole texts or sets.
BATCH_ROWS = 256


def get_session(master: str | None = None, app: str = "corpuskiln", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution.

    Nothing cluster-specific is set here: the number of shuffle partitions, memory and the
    checkpoint folder belong to the cluster. ``conf`` takes extra settings with ``__`` for
    the dots, e.g. ``spark__sql__shuffle__partitions="8"``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; only a local master gets one of our own where none is set."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_corpuskiln_dir", None)
    if root is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = sc._corpuskiln_dir = tempfile.mkdtemp(prefix="corpuskiln-")
    return root


def shared_folder(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{_shared_root(spark)}/files-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of df from files in the shared folder: for what a plan reads several times and takes long to make."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(_shared_root(spark))
    return df.checkpoint(eager=True)


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def written(df: DataFrame) -> DataFrame:
    """As ``checkpointed``, but as compressed files, and without the shuffle files that made them."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    with _shuffles_dropped(spark):
        # The setting counts where the plan is made, so a new one is.
        df.select("*").write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._corpuskiln_path = path
    return made


def dropped(*frames: DataFrame) -> None:
    """Deletes the files of frames from ``written`` that nothing reads any more."""
    for df in frames:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df._corpuskiln_path)
        path.getFileSystem(conf).delete(path, True)


def collected(df: DataFrame) -> pa.Table:
    """The rows of a small df; the shuffle files that made them go."""
    with _shuffles_dropped(df.sparkSession):
        return df.select("*").toArrow()


def small_batches(df: DataFrame) -> DataFrame:
    """df, after the session is told to send few rows at once to Python."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df
