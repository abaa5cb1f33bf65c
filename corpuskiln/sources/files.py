"""Single files in any file system that Hadoop reaches: read, listed, and put in place by one rename."""

from __future__ import annotations

import uuid

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession


class FileExists(Exception):
    """A file of the name is there already."""


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def _context(spark: SparkSession, path: str):
    full = _system(spark, path).makeQualified(_path(spark, path))
    return spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(full.toUri(), spark._jsc.hadoopConfiguration()), full


def rename(spark: SparkSession, source: str, target: str, overwrite: bool) -> None:
    """One step for readers: they see what was there before, or the source. Without ``overwrite`` an existing target fails."""
    context, old = _context(spark, source)
    _, new = _context(spark, target)
    option = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark._sc._gateway.new_array(option, 1)
    options[0] = option.OVERWRITE if overwrite else option.NONE
    try:
        context.rename(old, new, options)
    except Exception as e:
        if not overwrite and ("FileAlreadyExistsException" in str(e) or "already exists" in str(e)):
            raise FileExists(target) from e
        raise


def delete(spark: SparkSession, path: str) -> None:
    _system(spark, path).delete(_path(spark, path), True)


def make_folder(spark: SparkSession, path: str) -> None:
    """The folder and those above it, where they are absent."""
    _system(spark, path).mkdirs(_path(spark, path))


def names(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder; none if it is absent."""
    fs = _system(spark, folder)
    if not fs.exists(_path(spark, folder)):
        return []
    return [s.getPath().getName() for s in fs.listStatus(_path(spark, folder))]


def read_text(spark: SparkSession, path: str) -> str:
    stream = _system(spark, path).open(_path(spark, path))
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = True) -> None:
    """A file that appears whole: written beside, then renamed."""
    beside = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}"
    stream = _system(spark, beside).create(_path(spark, beside), True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    try:
        rename(spark, beside, path, overwrite)
    except (FileExists, PySparkException):
        delete(spark, beside)
        raise
