"""Sources: JSON lines, JSON documents, globs of documents, splits, source files and logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import checkpointed


def read_jsonl(spark: SparkSession, path: str | Sequence[str], schema: str) -> DataFrame:
    """One record per line; blank lines are skipped, a bad line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_document(spark: SparkSession, path: str | Sequence[str], schema: str) -> DataFrame:
    """Whole files that each hold a JSON object, or an array of them; with ``file``, the name."""
    read = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return read.withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def read_glob(spark: SparkSession, folder: str, pattern: str, schema: str) -> DataFrame:
    """The documents whose names match a glob pattern, in no order; ``file`` sorts them."""
    return read_document(spark, f"{folder}/{pattern}", schema)


def read_labelled(spark: SparkSession, folder: str, labels: Sequence[str], parts: Sequence[str], schema: str) -> DataFrame:
    """The documents LABEL-PART.json, with ``label`` and ``part`` from the name."""
    read = read_document(spark, [f"{folder}/{a}-{b}.json" for a in labels for b in parts], schema)
    name = r"^(.*)-(" + "|".join(sorted(parts, key=len, reverse=True)) + r")\.json$"
    return read.withColumn("label", F.regexp_extract("file", name, 1)).withColumn("part", F.regexp_extract("file", name, 2))


def results_of(documents: DataFrame, *keep: str) -> DataFrame:
    """The rows of the documents' results, with their ordinal."""
    return documents.select(*keep, F.posexplode("results").alias("ordinal", "_r")).select(*keep, "ordinal", "_r.*")


def read_splits(spark: SparkSession, paths: Mapping[str, str], schema: str) -> DataFrame:
    """JSON-lines files by split name, with ``split``."""
    frames = [read_jsonl(spark, p, schema).withColumn("split", F.lit(name)) for name, p in paths.items()]
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small table written in code, with its order in ``ordinal``."""
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], f"{schema}, ordinal int")


def format_probes(spark: SparkSession, fences: int, objects: int, bullets: int, languages: Sequence[str]) -> DataFrame:
    """Probe rows numbered from 1: fences, then JSON objects, then bullet lists; languages take turns."""
    n = F.col("n")
    contract = F.when(n <= fences, "exact_fence").when(n <= fences + objects, "exact_json").otherwise("exact_bullets")
    kind = F.when(n <= fences, "fence").when(n <= fences + objects, "json").otherwise("bullets")
    language = F.element_at(F.array(*[F.lit(x) for x in languages]), F.pmod(n - 1, F.lit(len(languages))).cast("int") + 1)
    return spark.range(1, fences + objects + bullets + 1).withColumnRenamed("id", "n").select(F.format_string("format_%s_%02d", kind, n).alias("id"), contract.alias("contract"), language.alias("language"), n.alias("ordinal"))


def read_source_files(spark: SparkSession, path: str, most: int = 64 * 1024, skip_larger: bool = False) -> DataFrame:
    """(path, code) of files of at most ``most`` bytes; bytes that are no UTF-8 are replaced. A larger file fails the job, unless skipped."""
    files = spark.read.format("binaryFile").load(path)
    code = F.make_valid_utf8(F.col("content").cast("string"))
    if skip_larger:
        return files.where(F.col("length") <= most).select("path", code.alias("code"))
    large = F.concat(F.col("path"), F.lit(f" has more than {most} bytes"))
    return files.select("path", F.when(F.col("length") > most, F.raise_error(large)).otherwise(code).alias("code"))


PROGRESS = r"^\[(\d+)/(\d+)\] (\S+) (\S+)$"
VERDICT = r"^\s*(PASS|FAIL) \| ([0-9.]+)s$"


def parse_progress(lines: DataFrame, value: str = "value") -> DataFrame:
    """Log lines "[03/50] TASK LANGUAGE" and "  PASS | 1.5s" as columns; other lines go.

    One-line logs "[03/50] TASK PASS" come out with the verdict in ``passed`` and no language.
    """
    v = F.col(value)
    number, total, task, last = (F.regexp_extract(v, PROGRESS, i) for i in range(1, 5))
    verdict, seconds = F.regexp_extract(v, VERDICT, 1), F.regexp_extract(v, VERDICT, 2)
    one_line = last.isin("PASS", "FAIL")
    own = F.when(one_line, last).when(verdict != "", verdict)
    kept = lines.where(v.rlike(PROGRESS) | v.rlike(VERDICT))
    return kept.select(
        *[c for c in lines.columns if c != value],
        F.nullif(number, F.lit("")).cast("int").alias("number"), F.nullif(total, F.lit("")).cast("int").alias("total"), F.nullif(task, F.lit("")).alias("task"),
        F.when(~one_line, F.nullif(last, F.lit(""))).alias("language"), (own == "PASS").alias("passed"), F.nullif(seconds, F.lit("")).cast("double").alias("seconds"),
    )


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    return parse_progress(spark.read.text(path).withColumn("file", F.input_file_name()))


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """A row per task line of the logs, with the first verdict that follows it before the next task line, wherever Spark splits the files.

    Columns: file, block and line (the order in a file), number, total, task, language, passed, seconds; the last two are null without a verdict.
    Lines are numbered within the blocks that Spark reads. A task is carried on to later lines of its block; for verdicts before the
    first task line of a block, one row per block says which task was the last before it, so no window holds a file's lines.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")).withColumn("line", F.monotonically_increasing_id())
    # Numbered as read, so written once: a second reading could number other lines.
    parsed = checkpointed(parse_progress(lines)).withColumn("is_task", F.col("task").isNotNull())
    here = W.partitionBy("file", "block").orderBy("line")
    carried = F.last(F.when(F.col("is_task"), F.struct("block", "line")), ignorenulls=True)
    parsed = parsed.withColumn("owner", carried.over(here.rowsBetween(W.unboundedPreceding, 0)))
    last = parsed.groupBy("file", "block").agg(F.max(F.when(F.col("is_task"), F.struct("block", "line"))).alias("last"))
    last = last.withColumn("earlier", F.last("last", ignorenulls=True).over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)))
    last = last.select(F.col("file").alias("f"), F.col("block").alias("b"), "earlier")
    verdicts = parsed.where("NOT is_task").join(last, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")))
    verdicts = verdicts.select("file", F.coalesce("owner", "earlier").alias("owner"), F.struct("block", "line").alias("place"), F.struct("passed", "seconds").alias("verdict"))
    verdicts = verdicts.groupBy(F.col("file").alias("f"), F.col("owner").alias("of")).agg(F.min_by("verdict", "place").alias("verdict"))
    tasks = parsed.where("is_task").withColumn("own", F.struct("block", "line")).withColumnRenamed("passed", "at_once").drop("seconds")
    joined = tasks.join(verdicts, (F.col("file") == F.col("f")) & (F.col("own") == F.col("of")), "left")
    return joined.select("file", "block", "line", "number", "total", "task", "language", F.coalesce("at_once", "verdict.passed").alias("passed"), F.col("verdict.seconds").alias("seconds"))
