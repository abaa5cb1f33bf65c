"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII letters whose case the operators fold; other letters keep theirs.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Whether shuffle files go when the statement that wrote them ends; what is checkpointed no longer needs them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Text bytes that a Python worker holds in numpy form at once.
CHUNK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table; other columns, whatever their names, are not read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset.

    Only a local master, all of whose tasks run on this machine, gets one of our own; on a cluster the setting is required.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_corpuskiln_dir", None)
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = sc._corpuskiln_dir = tempfile.mkdtemp(prefix="corpuskiln-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """While this holds, the shuffle files of a statement go when it ends."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of df from files in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    with _shuffles_dropped(df.sparkSession):
        # The setting counts where the plan is made, so a new one is.
        return df.select("*").checkpoint(eager=True)


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows of df from a table in the shared folder, and its path: for what its user can drop again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    with _shuffles_dropped(spark):
        df.select("*").write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Removes a file or folder of the shared folder."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def text_chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each has about ``limit`` bytes of ``text``; a longer single text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0))
        group = np.cumsum(size, dtype=np.int64) // limit
        cuts = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield batch.slice(a, b - a)


def texts_of(batch: pa.RecordBatch) -> list[str]:
    """The texts as strings; null counts as empty."""
    return [x or "" for x in batch.column("text").to_pylist()]


def bytes_of(batch: pa.RecordBatch) -> list[bytes]:
    """The texts as UTF-8; null counts as empty."""
    return [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores after it until no column of df has it."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def small_batches(df: DataFrame) -> DataFrame:
    """df, after the session is told to send few rows at once to Python: rows here are whole texts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    return df
