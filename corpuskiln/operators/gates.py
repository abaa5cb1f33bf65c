"""Integrity constraints and release gates: every violation and every check is reported, callers decide."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

ROLES = (("user", "assistant"), ("system", "user", "assistant"))
#: Least scores of translations and of explanations; fixed values.
TRANSLATION_SCORE, EXPLANATION_SCORE, MUTATION_RATIO = 0.40, 0.45, 0.50


class GateError(RuntimeError):
    pass


def _violations(df: DataFrame, key: Column, checks: Mapping[str, Column]) -> DataFrame:
    """(check, key) for each check that a row fails; a null counts as failed."""
    failed = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]), lambda x: x.isNotNull())
    return df.select(key.cast("string").alias("key"), F.explode(failed).alias("check")).select("check", "key")


def message_checks(messages: Column) -> dict[str, Column]:
    roles = F.transform(messages, lambda m: m["role"])
    accepted = reduce(lambda x, y: x | y, [roles.eqNullSafe(F.array(*[F.lit(r) for r in rs])) for rs in ROLES])
    filled = F.forall(messages, lambda m: F.coalesce(F.length(X.strip(m["content"])) > 0, F.lit(False)))
    return {"message_roles": accepted, "message_content": filled}


def verification_checks(v: Column, methods: Sequence[str], source: Column, mutated_prefix: str) -> dict[str, Column]:
    adequate = (v["mutation_total"] >= 1) & (F.try_divide(v["mutation_killed"], v["mutation_total"]) >= MUTATION_RATIO)
    return {
        "verified": v["passed"],
        "translation_anchors": v["translation_anchors_verified"],
        "translation_score": v["translation_semantic_score"] >= TRANSLATION_SCORE,
        "explanation_anchors": v["explanation_translation_anchors_verified"],
        "explanation_score": v["explanation_translation_semantic_score"] >= EXPLANATION_SCORE,
        "explanation_method": v["explanation_verification_method"].isin(*methods),
        "mutation_adequacy": ~F.startswith(F.coalesce(source, F.lit("")), F.lit(mutated_prefix)) | F.coalesce(adequate, F.lit(False)),
    }


def row_violations(rows: DataFrame, key: str, messages: str = "messages", verification: str | None = None, methods: Sequence[str] = (), source: str = "source", mutated_prefix: str = "") -> DataFrame:
    checks = message_checks(F.col(messages))
    if verification:
        checks |= verification_checks(F.col(verification), methods, F.col(source), mutated_prefix)
    return _violations(rows, F.col(key), checks)


def leakage_violations(train: DataFrame, validation: DataFrame, family: str) -> DataFrame:
    both = train.select(family).intersect(validation.select(family))
    return both.select(F.lit("split_leakage").alias("check"), F.col(family).cast("string").alias("key"))


def lane_violations(rows: DataFrame, language: str, expected: Sequence[str]) -> DataFrame:
    """Lanes that are missing or not expected."""
    spark = rows.sparkSession
    wanted = spark.createDataFrame([(x,) for x in expected], "lane string")
    there = rows.select(F.col(language).alias("lane")).distinct()
    missing = wanted.join(there, "lane", "left_anti").select(F.lit("lane_missing").alias("check"), F.col("lane").alias("key"))
    extra = there.join(wanted, "lane", "left_anti").select(F.lit("lane_unexpected").alias("check"), F.coalesce("lane", F.lit("null")).alias("key"))
    return missing.unionByName(extra)


def size_violations(rows: DataFrame, least: int) -> DataFrame:
    n = rows.agg(F.count("*").alias("n"))
    return n.where((F.col("n") < least) | (F.col("n") == 0)).select(F.when(F.col("n") == 0, F.lit("empty")).otherwise(F.lit("too_few")).alias("check"), F.col("n").cast("string").alias("key"))


def empty_sides(rows: DataFrame, side: str, expected: Sequence[str]) -> DataFrame:
    """(check, key): the sides of a split that have no row."""
    wanted = rows.sparkSession.createDataFrame([(x,) for x in expected], "key string")
    there = rows.groupBy(F.col(side).alias("key")).agg(F.count("*").alias("n"))
    return wanted.join(there.select("key"), "key", "left_anti").select(F.lit("empty_side").alias("check"), "key")


def ratio_violations(rows: DataFrame, language: str, ratios: Mapping[str, float]) -> DataFrame:
    """Lanes whose count is not round(total * ratio), half to even, with actual and expected counts."""
    if abs(sum(ratios.values()) - 1.0) > 1e-9:
        raise ValueError("ratios must sum to 1")
    counts = rows.agg(F.count("*").alias("total"), *[F.count_if(F.col(language) == k).alias(k) for k in ratios])
    made = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("actual"), F.bround(F.col("total") * F.lit(r)).cast("long").alias("expected")) for k, r in ratios.items()])
    return counts.select(F.explode(made).alias("r")).select(F.lit("lane_ratio").alias("check"), "r.*").where("actual <> expected")


def parallel_violations(rows: DataFrame, group: str, language: str, declared: str, answer: str, expected: Sequence[str]) -> DataFrame:
    """Groups that lack a lane or differ in their declared hash, and rows that break the code lock or whose explanation is bad."""
    wanted = F.array(*[F.lit(x) for x in sorted(expected)])
    groups = rows.groupBy(group).agg(F.array_sort(F.collect_set(language)).alias("lanes"), F.count_distinct(declared).alias("hashes"), F.count_if(F.col(declared).isNull()).alias("none"))
    by_group = _violations(groups, F.col(group), {"lane_set": F.col("lanes").eqNullSafe(wanted), "declared_hash": (F.col("hashes") == 1) & (F.col("none") == 0)})
    found = X.fences(F.col(answer))
    body = X.strip(F.get(found, F.lit(0)))
    explanation = X.strip(F.regexp_replace(F.col(answer), r"(?s)\A.*?```.*?```", ""))
    by_row = _violations(
        rows, F.concat_ws(":", F.col(group), F.col(language)),
        {"one_fence": F.size(found) == 1, "code_lock": F.sha2(body, 256) == F.col(declared), "explanation": F.length(explanation) > 0, "repeated_words": ~X.collapses(explanation)},
    )
    return by_group.unionByName(by_row)


def uniqueness_violations(rows: DataFrame, group: str, language: str, text: str, share: float = 0.9) -> DataFrame:
    """Lanes with under max(1, round(share * groups)) different texts, which are told apart by 128 bits; the texts are not shuffled."""
    groups = rows.agg(F.count_distinct(group).alias("groups"))
    lanes = rows.groupBy(F.col(language).alias("key")).agg(F.count_distinct(F.md5(text)).alias("actual"))
    return lanes.crossJoin(F.broadcast(groups)).withColumn("expected", F.greatest(F.lit(1), F.bround(F.col("groups") * F.lit(share)).cast("long"))).where("actual < expected").select(F.lit("unique_texts").alias("check"), "key", "actual", "expected")


def require_none(violations: DataFrame, shown: int = 5) -> None:
    """Raises GateError if there are violations."""
    if first := violations.take(shown):
        raise GateError("; ".join(str(r.asDict()) for r in first))


def checkpoint_checks(candidate_is_direct: Column, c: Mapping[str, Column], b: Mapping[str, Column], r: Mapping[str, Column], formats: Sequence[Column]) -> dict[str, Column]:
    """Ten checks; their names are fixed values. c and b: the candidate's and the base's rates en, en_code, sw, sw_mix; r: repair rates."""
    return {
        "raw_model_only_evaluation": candidate_is_direct,
        "english_overall_not_below_base": c["en"] >= b["en"],
        "english_executable_code_not_below_base": c["en_code"] >= b["en_code"],
        "kiswahili_at_least_75_percent": c["sw"] >= 0.75,
        "kiswahili_gain_at_least_10_points": c["sw"] >= b["sw"] + 0.10,
        "code_switching_at_least_85_percent": c["sw_mix"] >= 0.85,
        "code_switching_gain_at_least_15_points": c["sw_mix"] >= b["sw_mix"] + 0.15,
        "format_compliance_at_least_98_percent": F.least(*formats) >= 0.98,
        "repair_pass_at_1_not_below_base": r["candidate_1"] >= r["base_1"],
        "repair_pass_at_2_not_below_base": r["candidate_2"] >= r["base_2"],
    }


def release_checks(candidate_is_direct: Column, c: Mapping[str, Column], b: Mapping[str, Column], r: Mapping[str, Column], formats: Sequence[Column], adherence: Mapping[str, Column], speed: Mapping[str, Column], memory: Mapping[str, Column]) -> dict[str, Column]:
    """Fifteen checks, their names fixed values, with the language adherence, speed and memory of candidate and base."""
    return {
        "raw_model_only_evaluation": candidate_is_direct,
        "kiswahili_at_least_75_percent": c["sw"] >= 0.75,
        "kiswahili_gain_at_least_10_points": c["sw"] - b["sw"] >= 0.10,
        "kiswahili_code_switching_at_least_85_percent": c["sw_mix"] >= 0.85,
        "kiswahili_code_switching_gain_at_least_15_points": c["sw_mix"] - b["sw_mix"] >= 0.15,
        "english_not_below_base": c["en"] >= b["en"],
        "english_executable_code_not_below_base": c["en_code"] >= b["en_code"],
        "all_language_formats_at_least_98_percent": F.least(*formats) >= 0.98,
        "kiswahili_language_adherence_at_least_80_percent": adherence["sw"] >= 0.80,
        "code_switch_language_adherence_at_least_80_percent": adherence["sw_mix"] >= 0.80,
        "repair_pass_at_1_not_lower": r["candidate_1"] >= r["base_1"],
        "repair_pass_at_2_not_lower": r["candidate_2"] >= r["base_2"],
        "throughput_within_3_percent": speed["candidate"] >= speed["base"] * 0.97,
        "peak_ram_within_128_mb": memory["candidate"] <= memory["base"] + 128,
        "peak_ram_below_7_gb": memory["candidate"] < 7168,
    }


def gate(metrics: DataFrame, checks: Mapping[str, Column], *keep: str) -> DataFrame:
    """metrics with ``checks`` (name to boolean; null fails) and ``passed``, whether all hold."""
    held = {k: F.coalesce(v, F.lit(False)) for k, v in checks.items()}
    everything = reduce(lambda x, y: x & y, held.values())
    made = F.map_from_arrays(F.array(*[F.lit(k) for k in held]), F.array(*held.values()))
    return metrics.select(*keep, made.alias("checks"), everything.alias("passed"))


def check_rows(gated: DataFrame, *keep: str) -> DataFrame:
    """(check, ok) rows of a gate."""
    return gated.select(*keep, F.explode("checks").alias("check", "ok"))


def manifest_matches(manifest: DataFrame, schema: str, ratios: Mapping[str, float]) -> DataFrame:
    """One row (ok): whether the manifest has the schema tag and the target ratios."""
    same = reduce(lambda x, y: x & y, [F.try_element_at("target_ratios", F.lit(k)) == v for k, v in ratios.items()], F.size("target_ratios") == len(ratios))
    return manifest.select(F.coalesce((F.col("schema") == schema) & same, F.lit(False)).alias("ok"))


def parse_ratios(spec: str, names: Sequence[str]) -> dict[str, float]:
    """"a=0.6,b=0.4" for exactly these names; the values sum to 1."""
    made = {k.strip(): float(v) for k, _, v in (item.partition("=") for item in spec.split(","))}
    if set(made) != set(names) or abs(sum(made.values()) - 1.0) > 1e-9:
        raise ValueError(f"{spec!r} must name {sorted(names)} and sum to 1")
    return made


def parse_names(spec: str) -> list[str]:
    return [x.strip() for x in spec.split(",") if x.strip()]


def check_arguments(total: int, fraction: float) -> None:
    if not 8_000 <= total <= 15_000:
        raise ValueError("total must be 8,000 to 15,000")
    if not 0.01 <= fraction <= 0.20:
        raise ValueError("fraction must be 0.01 to 0.20")


def check_modes(model_only: bool, **options: object) -> None:
    """Options that a run of nothing but the model bars."""
    if model_only and (used := [k for k, v in options.items() if v]):
        raise ValueError(f"model_only bars {', '.join(sorted(used))}")
