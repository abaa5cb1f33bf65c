"""Row filters and selections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

#: Python words that show unfinished work, and what may not occur in stored solutions; fixed lists.
INCOMPLETE = r"\b(?:todo|fixme|your code here|not implemented|pass)\b"
UNSAFE_MARKERS = r"\b(?:subprocess|socket|requests|urllib|child_process)\b|\bopen\s*\(|\b(?:eval|exec|__import__)\s*\(|process\.env|require\s*\(\s*['\"](?:fs|net|http|https|os)"
#: In the order in which they are reported; a fixed list.
UNSAFE_PATTERNS = (
    r"\bimport\s+(?:os|sys|subprocess|socket|pathlib|urllib|requests)\b",
    r"\bfrom\s+(?:os|sys|subprocess|socket|pathlib|urllib)\b",
    r"\bopen\s*\(",
    r"\b(?:eval|exec|compile|__import__)\s*\(",
    r"child_process",
    r"require\s*\(\s*['\"](?:fs|net|http|https|child_process|os)['\"]",
    r"process\.(?:env|exit|kill)",
)
#: JavaScript constructs that candidates may not use; a fixed list.
SCRIPT_BANNED = ("require(", "import ", "process.", "child_process", "fetch(", "eval(", "function(", "websocket", "deno.", "bun.", "node:fs", "fs.")


def length_between(text: Column, low: int, high: int) -> Column:
    """On the code points of the stripped text."""
    return F.length(X.strip(text)).between(low, high)


def is_complete_and_safe(code: Column) -> Column:
    return ~code.rlike(f"(?iU){INCOMPLETE}") & ~code.rlike(f"(?iU){UNSAFE_MARKERS}")


def unsafe_reason(code: Column) -> Column:
    return X.first_match(code, UNSAFE_PATTERNS)


def script_reason(code: Column) -> Column:
    return X.squeezed_marker(code, SCRIPT_BANNED)


def changed(candidate: Column, original: Column) -> Column:
    return X.strip(candidate) != X.strip(original)


def scores_pass(thresholds: Mapping[str, float], *flags: Column) -> Column:
    """Every score reaches its threshold and every flag holds; nulls fail."""
    ok = F.lit(True)
    for name, least in thresholds.items():
        ok = ok & (F.col(name) >= least)
    for flag in flags:
        ok = ok & flag
    return F.coalesce(ok, F.lit(False))


def ratio_at_least(part: Column, whole: Column, least: float) -> Column:
    return F.coalesce((whole >= 1) & (F.try_divide(part, whole) >= least), F.lit(False))


def within_tokens(text: Column, most: int) -> Column:
    """Whole rows of at most ``most`` tokens: words, numbers and single marks."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]")) <= most


def without_errors(rows: DataFrame, error: str = "error") -> DataFrame:
    return rows.where(F.coalesce(F.col(error), F.lit("")) == "")


def is_direct_model(row: str | None = None) -> Column:
    """The seven provenance fields of a run that used nothing but the model; absent flags count as false."""
    c = lambda n: F.col(f"{row}.{n}" if row else n)
    off = [~F.coalesce(c(n), F.lit(False)) for n in ("application_contract", "self_review", "translate_then_solve", "nllb_roundtrip_explanations")]
    on = F.coalesce(c("model_only"), F.lit(False)) & (F.coalesce(c("application_prompt_strategy"), F.lit("")) == "direct")
    for flag in off:
        on = on & flag
    return on & (F.coalesce(c("nllb_model"), F.lit("")) == "")


def select_ids(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of the table with one of the ids, as a semi join."""
    return table.join(ids.select(key).distinct(), key, "left_semi")


def unknown_ids(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The ids that the table lacks; must be empty."""
    return ids.select(key).distinct().join(table, key, "left_anti")


def select_cases(cases: DataFrame, key: str, order: str, ids: DataFrame | Sequence | None = None, limit: int | None = None) -> DataFrame:
    """The cases with the ids, or else the first ``limit`` by order (clamped at 0).

    Ids that no case has are an error. Ids come as a table, of any size, or as a short list.
    """
    if ids is None or (not isinstance(ids, DataFrame) and not ids):
        return cases if limit is None else cases.orderBy(order).limit(max(0, limit))
    if not isinstance(ids, DataFrame):
        ids = cases.sparkSession.createDataFrame([(x,) for x in ids], cases.select(key).schema)
    if unknown := unknown_ids(cases, ids, key).take(10):
        raise ValueError(f"unknown ids: {[r[0] for r in unknown]}")
    return select_ids(cases, ids, key)


def pair_between(prompt: Column, answer: Column, prompt_band: tuple[int, int] = (40, 1800), answer_band: tuple[int, int] = (40, 5000)) -> Column:
    """Whether both sides of a pair have a length in their band."""
    return length_between(prompt, *prompt_band) & length_between(answer, *answer_band)
