"""Queries over programs that are made of whole texts: comments, docstrings, names and strings come from each document.

They have no SQL; tests hold them against other versions over all rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import python_code as PY
from ..functions import text as X
from ..operators import projections
from . import settings as S
from .catalogue import query, t


def _name(words: Column, k: int) -> Column:
    """The k-th word of the text that can be a name, with a letter before it."""
    return F.concat(F.lit("w"), F.coalesce(F.get(words, F.lit(k)), F.lit("")))


def _quoted(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def python_programs(spark, d, *more: str):
    """doc_id, entry, more columns of the documents, and a Python program: the first line as a comment, the text as docstring, its words as names, calls and imports.

    The words decide what the program does, and a fifth of the programs, those whose hash says so, are cut off in the middle of the text.
    """
    docs = t(spark, d, "documents").select("doc_id", "text", *[c for c in more if c != "text"])
    docs = docs.withColumn("w", F.regexp_extract_all("text", F.lit("[A-Za-z_]+"), F.lit(0))).withColumn("h", F.crc32(F.col("text").cast("binary")))
    w, h = F.col("w"), F.col("h")
    a, b, c, e = (_name(w, k) for k in (0, 1, 2, 3))
    docstring = F.concat(F.lit('    """'), _quoted(F.col("text")), F.lit(' """\n'))
    lead = F.when(h % 7 == 0, F.concat(F.lit("import "), a, F.lit(".x, os\n"))).when(h % 7 == 1, "from sys import path\n").otherwise("")
    body = F.concat(
        F.lit("    if "), b, F.lit(" < "), F.size(w).cast("string"), F.lit(" and "), c, F.lit(":\n        return "), b, F.lit(" * "), F.length("text").cast("string"), F.lit(" + 1\n"),
        F.when(h % 11 == 0, F.concat(F.lit("    "), c, F.lit(".__class__\n"))).when(h % 11 == 1, F.concat(F.lit("    eval("), c, F.lit(")\n"))).when(h % 11 == 2, F.concat(F.lit("    "), b, F.lit(" == 1\n"))).otherwise(""),
        F.lit('    return "'), F.replace(_quoted(F.col("text")), F.lit("\n"), F.lit("\\n")), F.lit('"\n'),
    )
    code = F.concat(F.lit("# "), F.regexp_replace(F.substring_index("text", "\n", 1), r"[\r\f\x0b\x00]", " "), F.lit("\n"), lead, F.lit("def "), a, F.lit("("), b, F.lit(": int, "), c, F.lit("=None, *"), e, F.lit("_: str) -> str:\n"), docstring, body, F.lit("\nprint("), a, F.lit("(1))\n"))
    cut = F.when(h % 5 == 0, F.substring(code, F.lit(1), F.floor(F.length(code) * 2 / 3).cast("int"))).otherwise(code)
    return docs.select("doc_id", a.alias("entry"), *more, cut.alias("code"))


def script_programs(spark, d):
    """doc_id and JavaScript: the text in a block comment, a string, a template and a line comment around functions and a call."""
    docs = t(spark, d, "documents").select("doc_id", "text").withColumn("w", F.regexp_extract_all("text", F.lit("[A-Za-z_]+"), F.lit(0)))
    text, a, b = F.col("text"), _name(F.col("w"), 0), _name(F.col("w"), 1)
    line = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("\n"), F.lit("\\\n"))
    code = F.concat(F.lit("/* "), text, F.lit(" */\nfunction "), a, F.lit("("), b, F.lit(") { if ("), b, F.lit(") { return '{"), line, F.lit("'; } }\nconst "), b, F.lit(" = (x) => { return `"), F.replace(text, F.lit("`"), F.lit("\\`")), F.lit("}`; };  // } "), F.substring_index("text", "\n", 1), F.lit("\n"), a, F.lit("("), F.size("w").cast("string"), F.lit(");\n"))
    return docs.select("doc_id", code.alias("code"))


@query()
def program_findings(spark, d):
    """What the preflight and the static gate say of each program, and whether it compiles."""
    p = python_programs(spark, d)
    return p.select("doc_id", PY.preflight_udf("code").alias("preflight"), PY.static_gate_udf("code").alias("static_gate"), PY.compiles_udf("code").alias("compiles"))


@query()
def program_contracts(spark, d):
    """Signature and requirement of each program's function, and the names that the program defines."""
    p = python_programs(spark, d)
    return p.select("doc_id", PY.function_contract_udf("code", "entry").alias("c"), F.array_join(X.defined_names(F.col("code")), ", ").alias("names")).select("doc_id", "c.*", "names")


@query()
def program_trims(spark, d):
    """Each program without its demonstration, and as the answer that the normaliser makes of it."""
    normal = PY.normalize_code_udf(explanations={"en": "Done."}, local_terms={"en": S.LEXICON["en"]}, mixed_terms=S.TERMS, mixed=(), default="en")
    p = python_programs(spark, d).select("doc_id", PY.trim_python_udf("code").alias("trimmed"), normal("code", F.lit("python"), F.lit("en")).alias("n"))
    return p.select("doc_id", "trimmed", "n.text", F.array_join("n.actions", ",").alias("actions"))


@query()
def program_mutants(spark, d):
    """Up to four mutants of each program."""
    return python_programs(spark, d).select("doc_id", F.posexplode(PY.mutants_udf("code")).alias("ordinal", "mutant"))


@query()
def script_masks(spark, d):
    """Each script with comments and strings blanked, and through its last block."""
    return script_programs(spark, d).select("doc_id", PY.mask_script_udf("code").alias("masked"), PY.trim_script_udf("code").alias("trimmed"))


@query()
def markdown_texts(spark, d):
    """Whole texts as Markdown, a fence after each blank line's paragraph, with the prose in capitals and the headings renamed."""
    text = F.concat(F.lit("# Notes\n\n"), F.col("text"), F.lit("\n\n```py\n"), F.col("text"), F.lit("\n```\n\nEnd:\n\n"), F.col("text"))
    return t(spark, d, "documents").select("doc_id", PY.map_markdown_udf(str.upper, {"Notes": "Hinweise", "End": "Ende"})(text).alias("text"))


@query()
def translated_contracts(spark, d):
    """The whole chain of a translation: glossary hits, the model's text as a column, interfaces and block put back, all actions listed.

    The model's text is here that of the first document of the same source and language.
    """
    docs = t(spark, d, "documents").select("doc_id", "text", "source", "lang")
    model = docs.groupBy("source", "lang").agg(F.min_by("text", "doc_id").alias("model")).withColumnsRenamed({"source": "s", "lang": "l"})
    source = F.concat("text", F.lit(" Call "), "entry", F.lit("( x ) now.\n  "), F.replace("code", F.lit("\n"), F.lit("\n  ")))
    rows = python_programs(spark, d, "text", "source", "lang").select("doc_id", "source", "lang", source.alias("given"))
    # What a program alone decides is worked out where it is read, each once.
    rows = rows.select("doc_id", "source", "lang", X.contract_parts(F.col("given")).alias("parts"), X.substitute_phrases(F.col("given"), S.PHRASES).alias("made"))
    rows = rows.select("doc_id", "source", "lang", "parts", F.sha2("made.text", 256).alias("prepared_sha256"), F.transform("made.hits", lambda h: F.concat(h["source"], F.lit(">"), h["replacement"])).alias("hits"))
    rows = rows.join(model, F.col("source").eqNullSafe(F.col("s")) & F.col("lang").eqNullSafe(F.col("l")))
    rows = rows.select("doc_id", "prepared_sha256", "hits", X.restored_contract(F.col("parts"), F.col("model"), "Signature: ", "Code:").alias("r"))
    return rows.select("doc_id", "prepared_sha256", "r.text", F.array_join(F.concat("hits", "r.actions"), ",").alias("actions"))


@query()
def register_chain(spark, d):
    """Prompts of mixed lanes are those of the base lane with the lane's words in place, and the instruction of lane and kind after them."""
    lane = F.concat("lang", F.when(F.col("doc_id") % 2 == 0, "_mix").otherwise(""))
    docs = t(spark, d, "documents").withColumn("lane", lane)
    mixed = F.endswith(F.col("lane"), F.lit("_mix"))
    prompt = F.when(mixed, X.substitute(F.col("text"), S.SUBSTITUTES)).otherwise(F.col("text"))
    kind = F.when(F.col("n_chars") > 800, "code").otherwise("explanation")
    chosen = {("de", "code"): "Antworte kurz.", ("fr", "explanation"): "Explique."}
    return docs.select("doc_id", X.base_lane(F.col("lane")).alias("base"), projections.with_instruction(prompt, X.base_lane(F.col("lane")), kind, chosen).alias("prompt"))


@query()
def compiled_grades(spark, d):
    """Programs that were to be copied into a fence, a third of them with a change: whether they are exact, and compile."""
    given = F.concat(F.lit("```python\n"), F.col("code"), F.when(F.col("doc_id") % 3 == 0, "#").otherwise(""), F.lit("\n```"))
    return python_programs(spark, d).select("doc_id", X.grade_format(F.lit("exact_fence"), given, F.col("code"), F.array().cast("array<string>"), compiled=True).alias("g")).select("doc_id", "g.*")
