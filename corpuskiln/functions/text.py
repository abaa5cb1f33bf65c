"""Text functions as native column expressions.

White space and word characters are Unicode's, hence the (?U) flags. Nothing here runs Python per row.
Regular expressions over a whole lexicon are built once from literals.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .python_code import compiles_whole_udf, dedented_udf

LABELS = r"(?:python|py|javascript|js)"
LABELLED_FENCE = rf"(?is)```{LABELS}\s*\n(.*?)```"
CLOSED_FENCE = rf"(?is)```{LABELS}?\s*\n(.*?)```"
OPEN_FENCE = rf"(?is)```{LABELS}?\s*\n(.*)$"
ANY_FENCE = r"(?s)```.*?```"
EXACT_FENCE = r"(?s)\A```python\n(.*?)\n?```\z"


def _java(text: str) -> str:
    """A literal inside a Java (and RE2) pattern."""
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", text)


def any_of(words: Sequence[str]) -> str:
    """An alternation of literals, longer ones first so that none hides another."""
    return "|".join(_java(w) for w in sorted(words, key=lambda w: (-len(w), w)))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def stable_id(text: Column) -> Column:
    """The first 20 hex digits of the SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 20)


def hash_bucket(key: Column, buckets: int) -> Column:
    """The first 8 hex digits of the SHA-256, as a number, modulo ``buckets``."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("bigint") % buckets


def hash_order(key: Column, seed: int) -> Column:
    """A pseudo-random, reproducible sort key: the SHA-256 of "seed:key"."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), key.cast("string")), 256)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def collapse_space(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", " ")


def casefold(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def dedup_key(text: Column) -> Column:
    """Equal for texts that differ in case and amount of white space only."""
    return stable_id(collapse_space(F.lower(text)))


def clean_prompt(text: Column) -> Column:
    """Drops scrape residue and leading hashes, collapses white space."""
    text = F.regexp_replace(text, r"(?iU)>\s*indented block", " ")
    text = F.regexp_replace(text, r"(?U)\A\s*#+\s*", "")
    return strip(collapse_space(text))


def clean_translation(text: Column) -> Column:
    return collapse_space(strip(F.replace(text, F.lit("```"), F.lit(""))))


def tail(text: Column, n: int) -> Column:
    """The last n characters; all of a shorter text."""
    return F.right(text, F.lit(n))


def after_last(text: Column, marker: str) -> Column:
    """What follows the last marker, stripped; empty without one."""
    return F.when(F.contains(text, F.lit(marker)), strip(F.substring_index(text, marker, -1))).otherwise("")


def non_blank_lines(text: Column) -> Column:
    return F.filter(F.split(text, r"\R"), lambda x: F.length(strip(x)) > 0)


def lines(text: Column) -> Column:
    """The lines without their ends; a final line end opens no new line; none for an empty text."""
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, r"\R\z", ""), r"\R", -1))


def lines_with(text: Column, word: str) -> Column:
    """Lines that contain the word, at least 1."""
    return F.greatest(F.lit(1), F.size(F.filter(F.split(text, r"\R"), lambda x: F.contains(x, F.lit(word)))))


def matches_any_case(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?iU){pattern}")


def first_match(text: Column, patterns: Sequence[str]) -> Column:
    """The first of the patterns (any case) that is found in the text, else null."""
    return F.coalesce(*[F.when(text.rlike(f"(?iU){p}"), F.lit(p)) for p in patterns])


def squeezed_marker(text: Column, markers: Sequence[str]) -> Column:
    """The first marker found in the text without white space and in lower case, else null."""
    flat = F.regexp_replace(F.lower(text), r"(?U)\s+", "")
    return F.coalesce(*[F.when(F.contains(flat, F.lit(m.replace(" ", ""))), F.lit(m)) for m in markers])


def forbidden_call(code: Column, names: Column) -> Column:
    """The first of the row's construct names that the code calls, else null.

    ".name" is matched anywhere, "name" not inside a longer identifier.
    """
    name = lambda x: F.rtrim(F.regexp_replace(x, r"[(\s]+\z", ""))
    pattern = lambda x: F.concat(F.when(F.startswith(x, F.lit(".")), F.lit("(?iU)")).otherwise(F.lit(r"(?iU)(?<![\w$])")), F.lit(r"\Q"), name(x), F.lit(r"\E\s*\("))
    return F.get(F.filter(names, lambda x: F.rlike(code, pattern(x))), F.lit(0))


def fences(text: Column) -> Column:
    """The bodies of closed fences that name a language."""
    return F.regexp_extract_all(text, F.lit(LABELLED_FENCE), F.lit(1))


def extract_code(text: Column) -> Column:
    """struct(code, closed): the first closed fence, else what follows an open one, else null."""
    has, opened = text.rlike(CLOSED_FENCE), text.rlike(OPEN_FENCE)
    code = F.when(has, strip(F.regexp_extract(text, CLOSED_FENCE, 1))).when(opened, strip(F.regexp_extract(text, OPEN_FENCE, 1)))
    return F.struct(code.alias("code"), has.alias("closed"))


def extract_runtime_code(text: Column, runtime: Column) -> Column:
    """The first fence of the runtime's label, else the first without a label, with one final newline; else null."""
    by = {"python": r"(?is)```(?:python|py)\s*\n(.*?)```", "javascript": r"(?is)```(?:javascript|js)\s*\n(.*?)```"}
    bare = r"(?s)```\s*\n(.*?)```"
    branch = lambda p: F.when(text.rlike(p), F.regexp_extract(text, p, 1)).when(text.rlike(bare), F.regexp_extract(text, bare, 1))
    found = F.when(runtime == "python", branch(by["python"])).otherwise(branch(by["javascript"]))
    return F.concat(strip(found), F.lit("\n"))


def prose(text: Column) -> Column:
    """The text with each fenced block replaced by a space."""
    return F.regexp_replace(text, ANY_FENCE, " ")


def words(text: Column) -> Column:
    """Runs of letters, case folded."""
    return F.regexp_extract_all(casefold(text), F.lit(r"[\p{L}\p{Nl}\p{No}]+"), F.lit(0))


def ascii_tokens(text: Column) -> Column:
    """Runs of ASCII letters, and numbers with an optional fraction, case folded."""
    return F.regexp_extract_all(casefold(text), F.lit(r"[a-z]+|[0-9]+(?:\.[0-9]+)?"), F.lit(0))


def literal_set(items: Sequence[str]) -> Column:
    return F.array(*[F.lit(x) for x in sorted(items)]) if items else F.array().cast("array<string>")


def lexicon_hits(text: Column, lexicon: Sequence[str]) -> Column:
    """The lexicon's words that occur in the prose, sorted."""
    return F.array_sort(F.array_intersect(words(prose(text)), literal_set(lexicon)))


def is_adherent(text: Column, lexicon: Sequence[str], least: int | Column, terms: Sequence[str] | None = None) -> Column:
    """Enough lexicon words; with ``terms`` (mixed lanes) also one of these."""
    ok = F.size(lexicon_hits(text, lexicon)) >= least
    return ok & (F.size(lexicon_hits(text, terms)) >= 1) if terms else ok


def substitute(text: Column, mapping: Mapping[str, str]) -> Column:
    """Whole words or phrases, any case, by their mapped value, in one pass: values are not looked at again.

    Where several keys begin at one place, the one that stands first in the mapping is taken.
    """
    pattern = r"(?iU)\b(?:" + "|".join(_java(k) for k in mapping) + r")\b"
    table = F.create_map(*[F.lit(x) for k, v in mapping.items() for x in (k.lower(), v)])
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda w: F.coalesce(F.try_element_at(table, F.lower(w)), w))
    between = F.split(text, pattern, -1)
    return F.array_join(F.zip_with(between, F.concat(found, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")


def substitute_phrases(text: Column, glossary: Sequence[tuple[str, str]]) -> Column:
    """struct(text, hits): phrases replaced one after the other in the order given, and which occurred."""
    hits = []
    for phrase, value in glossary:
        pattern = rf"(?iU)(?<!\w){_java(phrase)}(?!\w)"
        hits.append(F.when(text.rlike(pattern), F.struct(F.lit(phrase).alias("source"), F.lit(value).alias("replacement"))))
        text = F.regexp_replace(text, pattern, value.replace("\\", "\\\\").replace("$", "\\$"))
    return F.struct(text.alias("text"), F.filter(F.array(*hits), lambda x: x.isNotNull()).alias("hits"))


#: Notation that a translation must carry over unchanged; a fixed pattern.
PROTECTED_TOKENS = r"(?iU)(?<!\w)(?:O\([^\s,;.]+\)|===|==|!==|!=|<=|>=|TypeError|NoneType|JavaScript|Python|None)(?!\w)"


def missing_tokens(source: Column, target: Column, pattern: str = PROTECTED_TOKENS) -> Column:
    """The source's distinct matches, in order, that the target lacks in any case."""
    found = F.array_distinct(F.regexp_extract_all(source, F.lit(pattern), F.lit(0)))
    return F.filter(found, lambda x: ~F.contains(casefold(target), casefold(x)))


def restore_tokens(source: Column, target: Column, lead: str, pattern: str = PROTECTED_TOKENS) -> Column:
    """The target, with a closing sentence that lists what it lacks."""
    missing = missing_tokens(source, target, pattern)
    ended = F.concat(F.regexp_replace(target, r"(?U)\s+\z", ""), F.lit("\n\n" + lead), F.array_join(missing, ", "), F.lit("."))
    return F.when(F.size(missing) == 0, target).otherwise(ended)


#: A call signature in prose, and the source block that a text ends in; fixed patterns.
INTERFACE = r"(?U)(?<![.\w])([A-Za-z_$][\w$]*)\s*\(([^()\n]*)\)"
SOURCE_BLOCK = r"(?dmsU)^([ \t]*(?:def\s+[A-Za-z_]\w*\s*\([^\n]*\)\s*:|(?:async\s+)?function\s+[A-Za-z_$][\w$]*\s*\([^\n]*\)\s*\{).*)$"


def interfaces(text: Column) -> Column:
    """The distinct call signatures of a text, in order, with the arguments stripped."""
    found = lambda t, k: F.regexp_extract_all(t, F.lit(INTERFACE), F.lit(k))
    return _let(text, lambda t: F.array_distinct(F.zip_with(found(t, 1), found(t, 2), lambda n, a: F.concat(n, F.lit("("), strip(a), F.lit(")")))))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def contract_parts(source: Column) -> Column:
    """struct(interfaces, code): the signatures of the source's prose, and its code block without the shared indentation, null if it has none."""
    block = F.regexp_extract(source, SOURCE_BLOCK, 1)
    prose = F.substring(source, F.lit(1), F.length(source) - F.length(block))
    return F.struct(interfaces(prose).alias("interfaces"), dedented_udf(F.nullif(block, F.lit(""))).alias("code"))


def restored_contract(parts: Column, translated: Column, interface_lead: str, block_lead: str) -> Column:
    """struct(text, actions): the translation, then the signatures of ``contract_parts`` that it lacks, then the code block."""

    def made(x: Column) -> Column:
        lost, code, target = x["lost"], x["code"], x["target"]
        signatures = F.when(F.size(lost) > 0, F.concat(F.lit(interface_lead), F.array_join(lost, ", "), F.lit(".")))
        ends = F.array_compact(F.array(signatures, F.concat(F.lit(f"{block_lead}\n```\n"), code, F.lit("\n```"))))
        actions = F.array_compact(F.array(F.when(F.size(lost) > 0, F.lit("restored_interface")), F.when(code.isNotNull(), F.lit("restored_source_code"))))
        ended = F.concat(F.regexp_replace(target, r"(?U)\s+\z", ""), F.lit("\n\n"), F.array_join(ends, "\n\n"))
        return F.struct(F.when(F.size(ends) > 0, ended).otherwise(target).alias("text"), actions.alias("actions"))

    lost = F.filter(parts["interfaces"], lambda c: ~F.contains(translated, c))
    return _let(F.struct(lost.alias("lost"), parts["code"].alias("code"), translated.alias("target")), made)


def restore_contract(source: Column, translated: Column, interface_lead: str, block_lead: str) -> Column:
    """struct(text, actions): the translation, then the signatures of the source's prose that it lacks, then the source's code block."""
    return restored_contract(contract_parts(source), translated, interface_lead, block_lead)


def present_terms(text: Column, terms: Sequence[str]) -> Column:
    """The terms, in the order given, that occur in the text as words, plural or not."""
    return F.filter(F.array(*[F.when(text.rlike(rf"(?iU)\b{_java(t)}s?\b"), F.lit(t)) for t in terms]), lambda x: x.isNotNull())


def append_terms(source: Column, target: Column, terms: Sequence[str], lead: str) -> Column:
    found = present_terms(source, terms)
    return F.when(F.size(found) == 0, target).otherwise(F.concat(target, F.lit(lead), F.array_join(found, ", "), F.lit(".")))


def bounded(text: Column, limit: int = 260) -> Column:
    """White space collapsed and final full stops dropped; longer texts cut at a word with an ellipsis."""
    flat = F.regexp_replace(strip(collapse_space(text)), r"\.+\z", "")
    cut = F.regexp_replace(F.substring(flat, 1, limit), r" [^ ]*\z", "")
    return F.when(F.length(flat) > limit, F.concat(F.regexp_replace(cut, r"[ ,;:]+\z", ""), F.lit("…"))).otherwise(flat)


def framed(text: Column, before: str, after: str, suffix: str | None = None) -> Column:
    """A stripped sentence, without a suffix sentence that starts as given, between two others."""
    flat = F.regexp_replace(strip(collapse_space(text)), r"\.+\z", "")
    if suffix:
        flat = F.regexp_replace(flat, rf"(?iU)\s+{_java(suffix)}.*\z", "")
    return F.concat(F.lit(before), F.regexp_replace(flat, r"[ .]+\z", ""), F.lit(after))


def defined_names(code: Column) -> Column:
    """Sorted distinct names that the code defines with def or class."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(code, F.lit(r"(?m)^\s*(?:def|class)\s+([A-Za-z_]\w*)"), F.lit(1))))


def overlap_f1(a: Column, b: Column) -> Column:
    """2 * common / (sizes), of two token arrays taken as sets; 0 for two empty ones."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    return 2 * F.size(F.array_intersect(x, y)) / F.greatest(F.lit(1), F.size(x) + F.size(y))


def jaccard(a: Column, b: Column) -> Column:
    """1 for two empty arrays."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.try_divide(F.size(F.array_intersect(a, b)), union))


def normalized_words(text: Column, aliases: Mapping[str, str], stop: Sequence[str], least: int = 3) -> Column:
    """The set of words of at least ``least`` letters: plural s dropped beyond four letters, aliases resolved, stop words left out."""
    found = F.regexp_extract_all(casefold(text), F.lit(rf"[\p{{L}}\p{{Nl}}\p{{No}}]{{{least},}}"), F.lit(0))
    single = F.transform(found, lambda w: F.when(F.endswith(w, F.lit("s")) & (F.length(w) > 4), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w))
    if aliases:
        table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
        single = F.transform(single, lambda w: F.coalesce(F.try_element_at(table, w), w))
    kept = F.filter(single, lambda w: ~w.isin(*stop)) if stop else single
    return F.array_distinct(kept)


def numbers(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0)))


def anchors_kept(source: Column, target: Column, groups: Sequence[Sequence[Sequence[str]]], negations: Sequence[str]) -> Column:
    """Whether both texts have the same numbers, hit the same alternatives of each contrast group, and both negate or neither."""
    a, b = ascii_tokens(source), ascii_tokens(target)
    same = F.array_sort(numbers(source)).eqNullSafe(F.array_sort(numbers(target)))
    for terms in [*[t for g in groups for t in g], negations]:
        same = same & (F.arrays_overlap(a, literal_set(terms)) == F.arrays_overlap(b, literal_set(terms)))
    return same


REPEATED_WORD = r"(?iU)\b([\w'-]+)(?:\s+\1){2,}\b"


def collapses(text: Column) -> Column:
    """Whether some word stands three times in a row."""
    return text.rlike(REPEATED_WORD)


def sentence_hint(text: Column, is_mixed: Column, term_pattern: str, suffix: str) -> Column:
    """struct(text, actions): in mixed lanes a suffix is added to prose with under two different terms."""
    plain = strip(text)
    terms = F.array_distinct(F.regexp_extract_all(casefold(prose(plain)), F.lit(term_pattern), F.lit(0)))
    adds = is_mixed & (F.length(plain) > 0) & (F.size(terms) < 2)
    return F.struct(
        F.when(adds, F.concat(plain, F.lit("\n\n" + suffix))).otherwise(plain).alias("text"),
        F.when(adds, F.array(F.lit("added_mixed_explanation_register"))).otherwise(F.array().cast("array<string>")).alias("actions"),
    )


def json_exact(text: Column, expected: Column) -> Column:
    """struct(passed, reason): whether a JSON object has the expected values and the expected order of keys."""
    plain = strip(text)
    parsed, wanted = F.try_parse_json(plain), F.try_parse_json(expected)
    reason = (
        F.when(F.contains(plain, F.lit("```")), F.lit("JSON was wrapped in Markdown"))
        .when(parsed.isNull(), F.lit("invalid JSON"))
        .when((F.to_json(parsed) != F.to_json(wanted)) | ~F.json_object_keys(plain).eqNullSafe(F.json_object_keys(expected)), F.lit("JSON keys or values changed"))
        .otherwise(F.lit("passed"))
    )
    return F.struct((reason == "passed").alias("passed"), reason.alias("reason"))


def fence_exact(text: Column, expected: Column) -> Column:
    plain = strip(text)
    reason = (
        F.when(~plain.rlike(r"(?s)\A```python\n(.*?)\n```\z") | (F.size(F.split(plain, "```")) != 3), F.lit("response is not exactly one closed python fence"))
        .when(F.regexp_extract(plain, r"(?s)\A```python\n(.*?)\n```\z", 1) != expected, F.lit("code changed while copying"))
        .otherwise(F.lit("passed"))
    )
    return F.struct((reason == "passed").alias("passed"), reason.alias("reason"))


def lines_exact(text: Column, expected: Column) -> Column:
    reason = F.when(lines(strip(text)).eqNullSafe(expected), F.lit("passed")).otherwise(F.lit("bullet lines, ordering, or extra prose differ"))
    return F.struct((reason == "passed").alias("passed"), reason.alias("reason"))


def fence_compiled(text: Column, expected: Column) -> Column:
    """As ``fence_exact``, and what was copied must compile as Python; it is not run."""
    graded = fence_exact(text, expected)
    failed = F.struct(F.lit(False).alias("passed"), F.lit("copied code does not compile").alias("reason"))
    return F.when(graded["passed"] & ~compiles_whole_udf(expected), failed).otherwise(graded)


def grade_format(contract: Column, text: Column, expected_text: Column, expected_lines: Column, compiled: bool = False) -> Column:
    """struct(passed, reason) by the contract's kind; with ``compiled`` fenced code must also compile."""
    return F.when(contract == "exact_fence", (fence_compiled if compiled else fence_exact)(text, expected_text)).when(contract == "exact_json", json_exact(text, expected_text)).otherwise(lines_exact(text, expected_lines))


def share_matched(text: Column, patterns: Sequence[str]) -> Column:
    """The part of the patterns (any case) that the text matches."""
    return reduce(lambda x, y: x + y, [matches_any_case(text, p).cast("int") for p in patterns]) / F.lit(float(len(patterns)))


def round_half_even(x: Column, digits: int) -> Column:
    return F.bround(x, digits)


def safe_rate(part: Column, whole: Column, digits: int | None = 4) -> Column:
    """part / whole, rounded half to even; 0 for an empty whole."""
    rate = F.coalesce(F.try_divide(part, whole), F.lit(0.0))
    return rate if digits is None else F.bround(rate, digits)


def compact_json(*columns: Column | str) -> Column:
    return F.to_json(F.struct(*columns))


def padded_id(prefix: str, n: Column, width: int = 2) -> Column:
    return F.format_string(f"{prefix}%0{width}d", n)


def base_lane(language: Column, suffixes: Sequence[str] = ("_mix", "-mix")) -> Column:
    """The lane that a mixed lane is a mixture with."""
    return F.regexp_replace(language, "(?:" + any_of(suffixes) + r")\z", "")


def runtime_name(runtime: Column) -> Column:
    return F.when(runtime == "python", F.lit("python")).otherwise(F.lit("javascript"))


def result_key(task: Column, language: Column) -> Column:
    return F.concat_ws(":", task, language)


def relocked(prompt: Column, translated: Column, contract: str, label: str, render: str) -> Column:
    """A translated prompt with the exact signature of the original put back.

    contract: a pattern whose group 1 is the signature; label: what opens the translated requirement;
    render: the sentence, with {signature} and {requirement}. Null where the prompt has no contract.
    """
    requirement = strip(F.get(F.reverse(F.split(translated, rf"(?iU){label}", 2)), F.lit(0)))
    signature = F.regexp_extract(prompt, contract, 1)
    head, rest = render.split("{signature}")
    middle, end = rest.split("{requirement}")
    return F.when(prompt.rlike(contract), F.concat(F.lit(head), signature, F.lit(middle), requirement, F.lit(end)))
