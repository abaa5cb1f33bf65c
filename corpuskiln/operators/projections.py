"""Projections: pairs, messages, prompts, answers, expansions."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

#: Names under which sources keep a pair, in the order tried; fixed values.
PAIR_KEYS = (("query", "answer"), ("instruction", "output"), ("prompt", "response"))


def last_content(messages: Column, role: str) -> Column:
    own = F.filter(messages, lambda m: m["role"] == role)
    return F.try_element_at(own, F.lit(-1))["content"]


def extract_pair(df: DataFrame, messages: str | None = "messages", keys: Sequence[tuple[str, str]] = PAIR_KEYS) -> Column:
    """struct(prompt, answer), stripped: the first pair of columns that both hold text, else the last user and assistant message; else null."""
    tried = []
    for a, b in keys:
        if a in df.columns and b in df.columns:
            tried.append(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.struct(X.strip(F.col(a)).alias("prompt"), X.strip(F.col(b)).alias("answer"))))
    if messages and messages in df.columns:
        user, assistant = last_content(F.col(messages), "user"), last_content(F.col(messages), "assistant")
        tried.append(F.when(user.isNotNull() & assistant.isNotNull(), F.struct(X.strip(user).alias("prompt"), X.strip(assistant).alias("answer"))))
    return F.coalesce(*tried)


def gather_messages(turns: DataFrame, key: str, turn: str, role: str, content: str) -> DataFrame:
    """One row per conversation with messages (role, content) in the order of turns."""
    gathered = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), F.col(role).alias("role"), F.col(content).alias("content"))))
    return turns.groupBy(key).agg(F.transform(gathered, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def chat_text(messages: Column) -> Column:
    """ROLE:, newline, content for each message, then END; blocks apart by a blank line."""
    blocks = F.transform(messages, lambda m: F.concat(F.upper(m["role"]), F.lit(":\n"), X.strip(m["content"])))
    return F.array_join(F.concat(blocks, F.array(F.lit("END\n"))), "\n\n")


def render_template(wrappers: Sequence[str], variant: Column, **fields: Column) -> Column:
    """wrappers[variant modulo their number] with {field} replaced; values are not looked at again."""

    def filled(wrapper: str) -> Column:
        parts = re.split(r"\{(" + "|".join(map(re.escape, fields)) + r")\}", wrapper) if fields else [wrapper]
        return F.concat(*[fields[x] if k % 2 else F.lit(x) for k, x in enumerate(parts)])

    return F.element_at(F.array(*[filled(w) for w in wrappers]), F.pmod(variant, F.lit(len(wrappers))).cast("int") + 1)


def render_answer(runtime: Column, code: Column, language: Column, explanations: Mapping[str, Column]) -> Column:
    """A fenced block of the runtime, a blank line and the language's explanation."""
    explanation = F.coalesce(*[F.when(language == k, v) for k, v in explanations.items()])
    return F.concat(F.lit("```"), X.runtime_name(runtime), F.lit("\n"), code, F.lit("\n```\n\n"), X.strip(explanation))


def keeps_code(answer: Column, code: Column) -> Column:
    """Whether the answer has exactly one labelled fence and its body is the code."""
    found = X.fences(answer)
    return (F.size(found) == 1) & X.strip(F.get(found, F.lit(0))).eqNullSafe(X.strip(code))


def expand_variants(df: DataFrame, variants: Column, *keep: str) -> DataFrame:
    """A row per struct of the array, its fields as columns, with its place as ``variant``."""
    return df.select(*keep, F.posexplode(variants).alias("variant", "_v")).select(*keep, "variant", "_v.*")


def lane_variants(language: Column, lane: Mapping[str, Sequence[Column]], hints: Mapping[str, Sequence[Column]], answer: Column, hint_answer: Column) -> Column:
    """The array of (kind, prompt, answer) for a lane: its full prompts, then its hints."""
    row = lambda kind, prompt, text: F.struct(F.lit(kind).alias("kind"), prompt.alias("prompt"), text.alias("answer"))
    made = [F.when(language == name, F.array(*[row("full", p, answer) for p in prompts], *[row("hint", p, hint_answer) for p in hints.get(name, ())])) for name, prompts in lane.items()]
    return F.coalesce(*made)


def overlay(rows: DataFrame, fields: DataFrame, key: str) -> DataFrame:
    """rows with the values that fields gives for their key, null ones too, in place of their own; new columns are added."""
    other = fields.select(F.col(key).alias("_k"), F.lit(True).alias("_there"), *[F.col(c).alias(f"_new_{c}") for c in fields.columns if c != key])
    joined = rows.join(other, F.col(key) == F.col("_k"), "left")
    kept = [F.when(F.col("_there"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in fields.columns and c != key else F.col(c) for c in rows.columns]
    added = [F.col(f"_new_{c}").alias(c) for c in fields.columns if c not in rows.columns]
    return joined.select(*kept, *added)


def zipped(df: DataFrame, *keep: str, **arrays: Column) -> DataFrame:
    """A row per place of the arrays, with ``ordinal``; arrays of different lengths in a row fail the job."""
    sizes = F.array_distinct(F.array(*[F.size(a) for a in arrays.values()]))
    same = F.when(F.size(sizes) > 1, F.raise_error(F.lit("arrays of different lengths"))).otherwise(F.arrays_zip(*[a.alias(n) for n, a in arrays.items()]))
    made = df.select(*keep, F.posexplode(same).alias("ordinal", "_z"))
    return made.select(*keep, "ordinal", *[F.col("_z")[n].alias(n) for n in arrays])


def null_as_zero_sum(*columns: Column) -> Column:
    return sum((F.coalesce(c, F.lit(0)) for c in columns[1:]), F.coalesce(columns[0], F.lit(0)))


def by_language(df: DataFrame, prefix: str, languages: Sequence[str], value: str, *keep: str) -> DataFrame:
    """Columns prefix_LANGUAGE as rows (language, value); rows of absent values go."""
    pairs = ", ".join(f"'{x}', `{prefix}_{x}`" for x in languages)
    return df.select(*keep, F.expr(f"stack({len(languages)}, {pairs}) AS (language, `{value}`)")).where(F.col(value).isNotNull())


def with_instruction(prompt: Column, lane: Column, kind: Column, instructions: Mapping[tuple[str, str], str]) -> Column:
    """The prompt, with the instruction of its lane and kind after a blank line where there is one."""
    found = F.coalesce(*[F.when((lane == a) & (kind == b), F.lit(v)) for (a, b), v in instructions.items()])
    return F.when(found.isNull(), prompt).otherwise(F.concat(prompt, F.lit("\n\n"), found))


def retry_prompt(base: Column, response: Column, detail: Column, lead: str, close: str) -> Column:
    """The base prompt with the ends of the feedback (1200 characters) and of the answer (3000)."""
    return F.concat_ws("\n\n", base, F.concat(F.lit(lead + "\n"), X.tail(detail, 1200)), X.tail(response, 3000), F.lit(close))
