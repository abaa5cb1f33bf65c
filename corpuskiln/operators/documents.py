"""Evaluation documents without a schema: parsed once as VARIANT, read by path, and paired by their roles."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import gates

#: What Python takes for false among the values of a document, as text; fixed values.
FALSY = ("false", "0", "0.0", "", "[]", "{}")
LANES = ("en", "sw", "sw_mix")


def read_by_role(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """(role, document): one row for each role, whose file holds one JSON value. A file that is no JSON fails the job."""
    parts = [spark.read.text(path, wholetext=True).select(F.lit(role).alias("role"), F.parse_json("value").alias("document")) for role, path in paths.items()]
    return reduce(DataFrame.unionByName, parts)


def at(document: Column, *path: str, kind: str = "double") -> Column:
    """The value at the path, or null. Keys may have any characters but an apostrophe."""
    return F.try_variant_get(document, "$" + "".join(f"['{k}']" for k in path), kind)


def side_by_side(documents: DataFrame, values: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """One row, with a column for each name: the value of its expression in the document of its role. A missing one fails the job."""
    found = documents.agg(*[F.max(F.when(F.col("role") == role, value)).alias(name) for name, (role, value) in values.items()])
    return found.select(*[F.when(F.col(n).isNull(), F.raise_error(F.lit(f"no {n} in the document of {role}"))).otherwise(F.col(n)).alias(n) for n, (role, _) in values.items()])


def is_direct(document: Column) -> Column:
    """Whether the document is of a run of nothing but the model: never null."""
    unset = ("application_contract", "self_review", "translate_then_solve", "nllb_model", "nllb_roundtrip_explanations")
    plain = F.coalesce(at(document, "model_only", kind="boolean"), F.lit(False)) & (F.coalesce(at(document, "application_prompt_strategy", kind="string"), F.lit("")) == "direct")
    return reduce(lambda x, y: x & y, [F.coalesce(at(document, k, kind="string").isin(*FALSY), F.lit(True)) for k in unset], plain)


def lane_metric(lane: str, name: str) -> Column:
    return at(F.col("document"), "summary", "languages", lane, name)


def repair_rate(name: str) -> Column:
    """A count of the summary over its total; a total of 0 is an error, as a missing one."""
    return F.try_divide(at(F.col("document"), "summary", name), at(F.col("document"), "summary", "total"))


def _metrics(sides: Mapping[str, str]) -> dict[str, tuple[str, Column]]:
    """What both gates read. sides: the prefix of the roles of the base and of the candidate."""
    out: dict[str, tuple[str, Column]] = {"direct": (f"{sides['c']}_paired", is_direct(F.col("document")))}
    for side, prefix in sides.items():
        out |= {f"{side}_{lane}": (f"{prefix}_paired", lane_metric(lane, "overall_pass_rate")) for lane in LANES}
        out[f"{side}_en_code"] = (f"{prefix}_paired", lane_metric("en", "code_pass_rate"))
        out |= {f"{side}_p{k}": (f"{prefix}_repairs", repair_rate(f"pass_at_{k}")) for k in (1, 2)}
    return out | {f"c_fmt_{lane}": (f"{sides['c']}_paired", lane_metric(lane, "format_compliance_rate")) for lane in LANES}


SIDES = {"b": "base", "c": "candidate"}


def _columns() -> tuple[dict[str, Column], dict[str, Column], dict[str, Column], list[Column]]:
    c, b = ({k: F.col(f"{side}_{k}") for k in (*LANES, "en_code")} for side in "cb")
    repairs = {f"{name}_{k}": F.col(f"{side}_p{k}") for side, name in SIDES.items() for k in (1, 2)}
    return c, b, repairs, [F.col(f"c_fmt_{lane}") for lane in LANES]


def checkpoint_gate(documents: DataFrame) -> DataFrame:
    """One row (checks, passed) from the documents of base_paired, candidate_paired, base_repairs and candidate_repairs."""
    c, b, repairs, formats = _columns()
    return gates.gate(side_by_side(documents, _metrics(SIDES)), gates.checkpoint_checks(F.col("direct"), c, b, repairs, formats))


def release_gate(documents: DataFrame) -> DataFrame:
    """As ``checkpoint_gate``, with the documents of base_profiler and candidate_profiler too."""
    values = _metrics(SIDES) | {f"c_adherence_{lane}": ("candidate_paired", lane_metric(lane, "language_adherence_rate")) for lane in ("sw", "sw_mix")}
    for side, name in SIDES.items():
        values[f"{side}_tps"] = (f"{name}_profiler", at(F.col("document"), "throughput", "tokens_per_second_generation"))
        values[f"{side}_rss"] = (f"{name}_profiler", at(F.col("document"), "memory", "peak_rss_mb"))
    c, b, repairs, formats = _columns()
    by_side = lambda k: {name: F.col(f"{side}_{k}") for side, name in SIDES.items()}
    adherence = {lane: F.col(f"c_adherence_{lane}") for lane in ("sw", "sw_mix")}
    return gates.gate(side_by_side(documents, values), gates.release_checks(F.col("direct"), c, b, repairs, formats, adherence, by_side("tps"), by_side("rss")))
