"""Tables that change by commits: folders of data, and a manifest per version that names those that count.

A version is there from the moment its manifest gets its name, by a rename that does not overwrite: of two writers of the
same version one fails, and nothing of it is seen. Readers take the folders of the newest manifest.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from contextlib import suppress
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files

MANIFESTS, DATA = "_manifests", "data"


@dataclass
class Version:
    number: int = 0
    folders: list[str] = field(default_factory=list)
    #: Marks of commits already made; a commit with one of them does nothing.
    marks: list[str] = field(default_factory=list)


class Snapshots:
    """The table in ``path``. ``merge`` says how its rows become fewer when it is compacted: by default not at all."""

    def __init__(self, spark: SparkSession, path: str, schema: str, merge: Callable[[DataFrame], DataFrame] = lambda df: df):
        self.spark, self.path, self.schema, self.merge = spark, path.rstrip("/"), schema, merge

    def version(self, number: int | None = None) -> Version:
        """The newest version, or that of the number."""
        have = sorted(int(n[:-5]) for n in files.names(self.spark, f"{self.path}/{MANIFESTS}") if n.endswith(".json") and not n.startswith("."))
        if number is None and not have:
            return Version()
        if number is not None and number not in have:
            raise ValueError(f"{self.path} has no version {number}")
        chosen = have[-1] if number is None else number
        return Version(**json.loads(files.read_text(self.spark, f"{self.path}/{MANIFESTS}/{chosen:012d}.json")))

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a version; none before the first commit."""
        folders = self.version(number).folders
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{DATA}/{x}" for x in folders])

    def _written(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/{DATA}/{name}")
        return name

    def _commit(self, version: Version) -> None:
        files.write_text(self.spark, f"{self.path}/{MANIFESTS}/{version.number:012d}.json", json.dumps(version.__dict__), overwrite=False)

    def append(self, rows: DataFrame, mark: str | None = None, tries: int = 5) -> bool:
        """Adds the rows as one commit; whether it did. A mark that is there already, as after a repeated batch, adds nothing."""
        if mark is not None and mark in self.version().marks:
            return False
        name = self._written(rows)
        for left in reversed(range(tries)):
            now = self.version()
            if mark is not None and mark in now.marks:
                files.delete(self.spark, f"{self.path}/{DATA}/{name}")
                return False
            try:
                self._commit(Version(now.number + 1, [*now.folders, name], [*now.marks, *([mark] if mark is not None else [])]))
                return True
            except files.FileExists:
                # Another writer was first; the rows are still good for the version after.
                if not left:
                    raise
        return False

    def compact(self, most: int = 1) -> bool:
        """Merges the rows into one folder if there are more than ``most``; whether it did. Readers of older versions are not disturbed."""
        now = self.version()
        if len(now.folders) <= most:
            return False
        name = self._written(self.merge(self.read(now.number)))
        # A commit in between is not lost: its folders stand beside the merged one.
        while True:
            later = self.version()
            try:
                self._commit(Version(later.number + 1, [name, *[x for x in later.folders if x not in now.folders]], later.marks))
                return True
            except files.FileExists:
                continue

    def vacuum(self, keep: int = 2) -> int:
        """Deletes folders that only versions before the last ``keep`` have; how many."""
        newest = self.version().number
        kept = {x for n in range(max(1, newest - keep + 1), newest + 1) for x in self.version(n).folders}
        old = [x for x in files.names(self.spark, f"{self.path}/{DATA}") if x not in kept]
        for x in old:
            files.delete(self.spark, f"{self.path}/{DATA}/{x}")
        return len(old)


def newest_by(key: list[str], order: str) -> Callable[[DataFrame], DataFrame]:
    """A merge that keeps the row of the highest ``order`` of each key."""

    def merge(df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c not in key]
        last = df.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_row"))
        return last.select(*[F.col(c) if c in key else F.col(f"_row.{c}").alias(c) for c in df.columns])

    return merge


class Cache:
    """Values by key in buckets, so that a lookup joins without a shuffle of the cache.

    The rows lie in a bucketed table; a manifest names its folder. New values are appended to it; ``compact`` writes one row of each key
    to a new folder and commits that. A key's first value counts until then and stays: the cache is for values that keys determine.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, value: str, schema: str, buckets: int = 64):
        self.spark, self.path, self.key, self.value, self.schema, self.buckets = spark, path.rstrip("/"), key, value, schema, buckets
        self.versions = Snapshots(spark, path, schema)
        if not self.versions.version().folders:
            with suppress(files.FileExists):
                self.versions._commit(Version(1, [uuid.uuid4().hex]))

    def _table(self, folder: str) -> str:
        name = f"cache_{folder}"
        files.make_folder(self.spark, f"{self.path}/{DATA}/{folder}")
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.createDataFrame([], self.schema).schema)
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (`{self.key}`) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{DATA}/{folder}'")
        return name

    def rows(self) -> DataFrame:
        return self.spark.table(self._table(self.versions.version().folders[-1]))

    def lookup(self, df: DataFrame) -> DataFrame:
        """df with the value of its key, null for a miss."""
        known = self.rows().groupBy(self.key).agg(F.min(self.value).alias(self.value)).withColumnRenamed(self.key, "_key")
        return df.join(known.hint("merge"), df[self.key] == F.col("_key"), "left").drop("_key")

    def append(self, computed: DataFrame) -> None:
        """Adds the values of keys that are not there; doing it again adds nothing."""
        new = computed.select(self.key, self.value).where(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.min(self.value).alias(self.value))
        missing = new.join(self.rows().select(F.col(self.key).alias("_key")).hint("merge"), F.col(self.key) == F.col("_key"), "left_anti")
        # What is written comes from a plan that reads the table, so it is laid beside first.
        beside = Snapshots(self.spark, f"{self.path}/new/{uuid.uuid4().hex}", self.schema)
        beside.append(missing)
        beside.read().write.insertInto(self._table(self.versions.version().folders[-1]))
        files.delete(self.spark, beside.path)

    def compact(self) -> None:
        """One file per bucket, one row per key."""
        folder = uuid.uuid4().hex
        kept = self.rows().groupBy(self.key).agg(F.min(self.value).alias(self.value))
        kept.repartition(self.buckets, self.key).write.insertInto(self._table(folder))
        now = self.versions.version()
        self.versions._commit(Version(now.number + 1, [folder], now.marks))
