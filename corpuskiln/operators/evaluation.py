"""Roll-ups of evaluation rows: lanes, pairs, breakdowns, runs, ranks and funnels.

Every summary is one hash aggregation with partial sums; only exact medians take passes of their own.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import safe_rate
from .filters import without_errors
from .selection import medians

#: Error names that show a call to something that does not exist; a fixed list.
API_ERROR_MARKERS = ("ModuleNotFoundError", "ImportError", "AttributeError", "NameError")
#: Weights of the lanes' pass rates and of the format rate, and of the composite's parts; fixed values.
ACCURACY_WEIGHTS = {"en": 0.30, "sw": 0.25, "sw_mix": 0.25, "format": 0.20}
ACCURACY_PART, SPEED_PART, MEMORY_PART = 0.50, 0.30, 0.20
FULL_SPEED, FULL_MEMORY_GB = 15.0, 7.0


def value_counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def count_map(df: DataFrame, column: str) -> DataFrame:
    """One row: the counts as a map."""
    counts = value_counts(df.where(F.col(column).isNotNull()), column)
    return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n")))).alias("counts"))


def sum_once_per_key(df: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """One row: the number of keys, and the sums of each key's last value."""
    last = df.groupBy(key).agg(*[F.max_by(v, order).alias(v) for v in values])
    return last.agg(F.count("*").alias("keys"), *[F.coalesce(F.sum(v), F.lit(0)).alias(v) for v in values])


def lane_counters() -> dict[str, Column]:
    """What a lane's summary is made of, but for the medians: counts and sums, so that parts can be added up."""
    ok = F.coalesce(F.col("error"), F.lit("")) == ""
    code, prose = ok & (F.col("kind") == "code"), ok & (F.col("kind") == "explanation")
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    seconds, tokens = F.when(ok, F.col("inference_seconds")), F.when(ok, F.col("completion_tokens"))
    return {
        "responses": count(ok), "error_rows": count(~ok), "code_passed": count(code & F.col("technical_pass")), "code_total": count(code),
        "format_compliant": count(code & F.col("format_compliant")), "side_effect_free": count(code & F.col("side_effect_free")),
        "explanations_passed": count(prose & F.col("technical_pass")), "explanations_total": count(prose),
        "overall_passed": count(ok & F.col("technical_pass")), "overall_total": count(ok), "language_adherent": count(ok & F.col("language_adherent")),
        "seconds_sum": F.sum(seconds), "seconds_count": F.count(seconds), "tokens_count": F.count(tokens), "total_completion_tokens": F.coalesce(F.sum(tokens), F.lit(0)),
    }


def lane_metrics(counters: DataFrame) -> DataFrame:
    """The summary's columns from counters and median_inference_seconds. Rates are rounded to four digits, half to even."""
    rates = {"code_pass_rate": ("code_passed", "code_total"), "format_compliance_rate": ("format_compliant", "code_total"), "side_effect_free_rate": ("side_effect_free", "code_total"), "explanation_pass_rate": ("explanations_passed", "explanations_total"), "overall_pass_rate": ("overall_passed", "overall_total"), "language_adherence_rate": ("language_adherent", "overall_total")}
    n = counters.withColumns({
        "mean_inference_seconds": F.bround(F.try_divide("seconds_sum", "seconds_count"), 3), "median_inference_seconds": F.bround("median_inference_seconds", 3),
        "mean_completion_tokens": F.bround(F.try_divide("total_completion_tokens", "tokens_count"), 2),
    }).drop("seconds_sum", "seconds_count", "tokens_count")
    return n.withColumns({k: safe_rate(F.col(a), F.col(b)) for k, (a, b) in rates.items()})


def lane_summary(rows: DataFrame, languages: Sequence[str] | None = None, *by: str) -> DataFrame:
    """The twenty metrics of each language, error rows aside (counted in error_rows).

    rows: language, kind (code or explanation), technical_pass, format_compliant, side_effect_free,
    language_adherent, inference_seconds, completion_tokens, error. Medians come from ``selection``.
    """
    rows = rows.where(F.col("language").isin(*languages)) if languages else rows
    keys = ["language", *by]
    counters = rows.groupBy(*keys).agg(*[c.alias(k) for k, c in lane_counters().items()])
    seconds = F.when(F.coalesce(F.col("error"), F.lit("")) == "", F.col("inference_seconds"))
    return lane_metrics(_with_medians(counters, medians(rows, seconds, keys, "median_inference_seconds"), keys))


def _with_medians(groups: DataFrame, middle: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The groups, which are as many as there are medians, each with its own."""
    other = middle.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    return groups.join(other, same, "left").drop(*[f"_{k}" for k in keys])


def complete_sets(rows: DataFrame, languages: Sequence[str], task: str = "task_id") -> DataFrame:
    """Tasks with a row in every language: one row each, with all_pass and a column pass_LANGUAGE per language."""
    own = without_errors(rows).where(F.col("language").isin(*languages))
    per = own.groupBy(task).agg(*[F.bool_or(F.when(F.col("language") == x, F.col("technical_pass"))).alias(f"pass_{x}") for x in languages])
    complete = per.na.drop(subset=[f"pass_{x}" for x in languages])
    everything = F.lit(True)
    for x in languages:
        everything = everything & F.col(f"pass_{x}")
    return complete.withColumn("all_pass", everything)


def paired_parity(rows: DataFrame, languages: Sequence[str], base: str = "en", task: str = "task_id") -> DataFrame:
    """Per other language, over complete tasks: outcomes equal to the base's, both pass, only the base passes."""
    sets = complete_sets(rows, languages, task)
    b = F.col(f"pass_{base}")
    parts = []
    for x in languages:
        if x != base:
            own = F.col(f"pass_{x}")
            parts.append(F.struct(F.lit(x).alias("language"), F.count_if(own == b).alias("same_outcome"), F.count_if(own & b).alias("both_pass"), F.count_if(~own & b).alias("only_base_passes")))
    return sets.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def pass_all_rate(rows: DataFrame, languages: Sequence[str], task: str = "task_id") -> DataFrame:
    sets = complete_sets(rows, languages, task).agg(F.count("*").alias("complete_sets"), F.count_if("all_pass").alias("all_passed"))
    return sets.withColumn("all_pass_rate", safe_rate(F.col("all_passed"), F.col("complete_sets")))


def breakdown(rows: DataFrame, first: str, second: str, passed: Column) -> DataFrame:
    """(dimension, value, passed, total) by each of two columns in one pass."""
    own = rows.select(F.coalesce(passed, F.lit(False)).alias("_p"), F.posexplode(F.array(F.col(first).cast("string"), F.col(second).cast("string"))).alias("_d", "value"))
    return own.groupBy(F.when(F.col("_d") == 0, F.lit(first)).otherwise(F.lit(second)).alias("dimension"), "value").agg(F.count_if("_p").alias("passed"), F.count("*").alias("total"))


def attempts_summary(attempts: DataFrame, key: str, attempt: str, passed: str) -> DataFrame:
    """Per key: the number of attempts, whether the first passed, whether one of the first two did, whether any did."""
    ok = F.coalesce(F.col(passed), F.lit(False))
    return attempts.groupBy(key).agg(F.count("*").alias("attempts"), F.min_by(ok, F.col(attempt)).alias("passed_first"), F.bool_or(ok & (F.col(attempt) <= 2)).alias("passed_in_two"), F.bool_or(ok).alias("passed"))


def repair_summary(rows: DataFrame, language: str = "language") -> DataFrame:
    """One row from rows (passed, passed_first_attempt, passed_in_two, language, duration_seconds)."""
    by = [F.count_if((F.col(language) == x) & c).alias(f"{x}_{n}") for x in ("python", "javascript") for n, c in (("passed", F.col("passed")), ("total", F.lit(True)))]
    n = rows.agg(F.count_if("passed").alias("passed"), F.count("*").alias("total"), F.count_if(F.coalesce("passed_first_attempt", "passed")).alias("pass_at_1"), F.count_if(F.coalesce("passed_in_two", "passed")).alias("pass_at_2"), *by, F.bround(F.coalesce(F.sum("duration_seconds"), F.lit(0.0)), 2).alias("duration_seconds"))
    return n.withColumn("pass_rate", safe_rate(F.col("passed"), F.col("total")))


def marker_rate(df: DataFrame, text: Column, markers: Sequence[str], *by: str) -> DataFrame:
    """The share of rows whose text contains any marker."""
    hit = F.lit(False)
    for m in markers:
        hit = hit | F.coalesce(F.contains(text, F.lit(m)), F.lit(False))
    n = df.groupBy(*by).agg(F.count_if(hit).alias("hits"), F.count("*").alias("total"))
    return n.withColumn("rate", safe_rate(F.col("hits"), F.col("total")))


def telemetry(df: DataFrame, speed: str, memory: str, *by: str, digits: int = 2) -> DataFrame:
    """Per group: the number of runs, the median speed, the highest memory, rounded to ``digits``."""
    runs = df.groupBy(*by).agg(F.count("*").alias("profiler_runs"), F.bround(F.max(memory), digits).alias("highest_peak_rss_mb"))
    joined = _with_medians(runs, medians(df, F.col(speed), by, "median_tps"), by)
    return joined.select(*by, "profiler_runs", F.bround("median_tps", digits).alias("median_tps"), "highest_peak_rss_mb")


def accuracy(rates: Mapping[str, Column]) -> Column:
    """100 times the weighted sum of the rates, by the weights' names."""
    return 100.0 * sum((F.lit(w) * rates[k] for k, w in ACCURACY_WEIGHTS.items()), F.lit(0.0))


def composite(accuracy_: Column, speed: Column, memory_mb: Column) -> Column:
    """struct of the accuracy, speed and memory parts (0 to 100) and the weighted total; null without telemetry."""
    fast = F.least(speed / FULL_SPEED, F.lit(1.0)) * 100.0
    small = F.greatest(F.lit(0.0), (FULL_MEMORY_GB - memory_mb / 1024.0) / FULL_MEMORY_GB) * 100.0
    total = ACCURACY_PART * accuracy_ + SPEED_PART * fast + MEMORY_PART * small
    made = F.struct(*[F.bround(c, 2).alias(n) for n, c in (("accuracy_component", accuracy_), ("performance_component", fast), ("efficiency_component", small), ("estimated_total", total))])
    return F.when(speed.isNotNull() & memory_mb.isNotNull(), made)


def rank_models(models: DataFrame, total: str, fallback: str, label: str) -> DataFrame:
    """models with rank (by total, or the fallback where there is none, descending; then the fallback, then the label) and score_basis.

    Models are few: one row per candidate under comparison.
    """
    score = F.coalesce(F.col(total), F.col(fallback))
    place = F.row_number().over(W.partitionBy(F.lit(1)).orderBy(score.desc(), F.col(fallback).desc(), F.col(label)))
    return models.withColumn("score_basis", F.when(F.col(total).isNull(), fallback).otherwise(total)).withColumn("rank", place)


def funnel(df: DataFrame, checks: Sequence[tuple[str, Column]], kept: str = "kept", *by: str) -> DataFrame:
    """(stage, n): each row counts at the first check that it fails, or as kept."""
    stage = F.coalesce(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks], F.lit(kept))
    return df.groupBy(*by, stage.alias("stage")).agg(F.count("*").alias("n"))


def retention(df: DataFrame, keep: Column, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("before"), F.count_if(keep).alias("after"))


def metric(document: Column, language: str, name: str, required: bool = True) -> Column:
    """document.summary.languages[language][name] as a double; a missing one fails the job, or is null if not required."""
    found = F.try_element_at(document["summary"]["languages"], F.lit(language))[name].cast("double")
    if not required:
        return found
    return F.when(found.isNull(), F.raise_error(F.lit(f"no {name} for {language}"))).otherwise(found)
