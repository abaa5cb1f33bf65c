"""A data set is validated as it is written: rows are counted on their way, groups are compared in what was written, and only a
data set without violations gets its name."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources import files
from . import gates


@dataclass
class Rules:
    """What a data set must keep. Columns: key, family (what may not be on both sides of the split), split, language, messages."""

    languages: Sequence[str]
    least_rows: int = 1
    key: str = "key"
    family: str = "family"
    split: str = "split"
    language: str = "language"
    messages: str = "messages"
    #: Further checks of a row; null counts as failed.
    row_checks: Mapping[str, Column] = field(default_factory=dict)
    #: Share of all rows that each language must have, to the rounded row.
    ratios: Mapping[str, float] | None = None
    #: The column of declared hashes: a family must have all languages, with one program whose hash is the declared one.
    declared: str | None = None




@dataclass
class Report:
    """failed: rows or groups that fail, by check, zeros included; examples: a key for each that fails; rows: how many there are."""

    rows: int
    failed: dict[str, int]
    examples: dict[str, str]

    @property
    def passed(self) -> bool:
        return not any(self.failed.values())


def _row_checks(rules: Rules) -> dict[str, Column]:
    known = F.col(rules.language).isin(*rules.languages)
    return gates.message_checks(F.col(rules.messages)) | {"lane_unexpected": known} | dict(rules.row_checks)


def _family_checks(spark: SparkSession, path: str, schema, rules: Rules) -> DataFrame:
    """(check, key) of families, from the columns of the written rows that it takes. Only hashes of answers are shuffled."""
    rows = spark.read.schema(schema).parquet(path)
    family = F.col(rules.family)
    sides = [F.bool_or(F.col(rules.split) == s).alias(s) for s in ("train", "validation")]
    more, checks = [], {"split_leakage": ~(F.col("train") & F.col("validation"))}
    if rules.declared:
        answer = F.element_at(F.col(rules.messages), -1)["content"]
        fences = X.fences(answer)
        locked = (F.size(fences) == 1) & (X.sha256(X.strip(F.get(fences, F.lit(0)))) == F.col(rules.declared))
        after = X.strip(F.substring_index(answer, "```", -1))
        more = [
            F.array_sort(F.collect_set(rules.language)).alias("lanes"), F.count_distinct(rules.declared).alias("hashes"), F.bool_or(F.col(rules.declared).isNull()).alias("undeclared"),
            F.bool_and(F.coalesce(locked, F.lit(False))).alias("locked"), F.bool_and(F.coalesce(F.length(after) > 0, F.lit(False))).alias("explained"), F.bool_or(F.coalesce(X.collapses(after), F.lit(False))).alias("collapsed"),
        ]
        everything = F.array(*[F.lit(x) for x in sorted(rules.languages)])
        checks |= {"parallel_family": family.isNotNull(), "lane_set": F.col("lanes") == everything, "declared_hash": (F.col("hashes") == 1) & ~F.col("undeclared"), "code_lock": F.col("locked"), "explanation": F.col("explained"), "repeated_words": ~F.col("collapsed")}
    found = gates._violations(rows.groupBy(family).agg(*sides, *more), family, checks)
    if not rules.declared:
        return found
    floor = gates.uniqueness_violations(rows.select(family.alias("f"), F.col(rules.language).alias("l"), F.md5(after).alias("x")), "f", "l", "x")
    return found.unionByName(floor.select(F.lit("unique_explanations").alias("check"), "key"))


def write_validated(rows: DataFrame, path: str, rules: Rules) -> Report:
    """Writes rows to ``path`` as Parquet if they keep all rules; else nothing is left there. All violations are in the report.

    The rows are made once: checks of rows are observed while they are written beside, and those of families and languages then read
    what was written, a few columns. A rename gives the result its name. An empty data set fails ("empty").
    """
    spark = rows.sparkSession
    beside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    checks = {k: F.coalesce(ok, F.lit(False)) for k, ok in _row_checks(rules).items()}
    seen = Observation()
    counts = [F.count(F.lit(1)).alias("rows"), *[F.count_if(~ok).alias(f"n_{k}") for k, ok in checks.items()], *[F.min(F.when(~ok, F.col(rules.key).cast("string"))).alias(f"key_{k}") for k, ok in checks.items()]]
    counts += [F.count_if(F.col(rules.language) == x).alias(f"lane_{x}") for x in rules.languages]
    rows.observe(seen, *counts).write.parquet(beside)
    got = seen.get
    total = got["rows"]
    failed = {"empty": int(total == 0), "too_few": int(0 < total < rules.least_rows)} | {k: got[f"n_{k}"] for k in checks}
    examples = {k: got[f"key_{k}"] for k in checks if got[f"n_{k}"]}
    missing = [x for x in rules.languages if not got[f"lane_{x}"]]
    off = [x for x, r in (rules.ratios or {}).items() if got[f"lane_{x}"] != round(total * r)]
    failed |= {"lane_missing": len(missing), "lane_ratio": len(off)}
    examples |= {k: v[0] for k, v in (("lane_missing", missing), ("lane_ratio", off)) if v}
    names = ["split_leakage"] + (["parallel_family", "lane_set", "declared_hash", "code_lock", "explanation", "repeated_words", "unique_explanations"] if rules.declared else [])
    failed |= dict.fromkeys(names, 0)
    if total:
        for r in _family_checks(spark, beside, rows.schema, rules).groupBy("check").agg(F.count("*").alias("n"), F.min("key").alias("key")).collect():
            failed[r["check"]] = r["n"]
            examples[r["check"]] = r["key"]
    report = Report(total, failed, examples)
    if report.passed:
        files.rename(spark, beside, path, overwrite=False)
    else:
        files.delete(spark, beside)
    return report
