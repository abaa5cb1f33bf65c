import difflib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuskiln.functions import python_code as PY
from corpuskiln.functions import text as X
from corpuskiln.operators import filters


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "closed", "code"),
    [
        ("a\n```python\nx = 1\n```\nb", True, "x = 1"),
        ("```\nx\n```", True, "x"),
        ("```js\nf()", False, "f()"),
        ("no code", False, None),
        ("```PY\r\nx\n```", True, "x"),
    ],
)
def test_extract_code(spark, text, closed, code):
    got = one(spark, X.extract_code(F.col("t")), t=text)
    assert (got["code"], got["closed"]) == (code, closed)


def test_runtime_code_falls_back_to_unlabelled(spark):
    f = X.extract_runtime_code(F.col("t"), F.col("r"))
    assert one(spark, f, t="```js\na\n```", r="javascript") == "a\n"
    assert one(spark, f, t="```\nb\n```", r="python") == "b\n"
    assert one(spark, f, t="b", r="python") is None


def test_strip_and_casefold_are_unicode(spark):
    assert one(spark, X.strip(F.col("t")), t="\t  a b \n ") == "a b"
    assert one(spark, X.casefold(F.col("t")), t="Straße É") == "strasse é"


def test_rounding_is_half_even(spark):
    assert one(spark, X.round_half_even(F.lit(2.5), 0)) == 2.0
    assert one(spark, X.round_half_even(F.lit(0.03125), 4)) == 0.0312
    assert one(spark, X.safe_rate(F.lit(1), F.lit(0))) == 0
    assert one(spark, X.safe_rate(F.lit(2), F.lit(3))) == 0.6667


def test_bounded_cuts_at_a_word(spark):
    text = "word " * 80
    got = one(spark, X.bounded(F.col("t")), t=text)
    assert got == ("word " * 52).strip() + "…" and len(got) <= 261
    assert one(spark, X.bounded(F.col("t")), t=" a\n b.. ") == "a b"


def test_lines_and_tail(spark):
    assert one(spark, X.lines(F.col("t")), t="a\nb\n") == ["a", "b"]
    assert one(spark, X.lines(F.col("t")), t="") == []
    assert one(spark, X.tail(F.col("t"), 3), t="abcdef") == "def"
    assert one(spark, X.after_last(F.col("t"), "##"), t="a##b## c ") == "c"
    assert one(spark, X.after_last(F.col("t"), "##"), t="abc") == ""
    assert one(spark, X.lines_with(F.col("t"), "assert"), t="assert a\nb\nassert c") == 2


def test_repeated_words(spark):
    f = X.collapses(F.col("t"))
    assert one(spark, f, t="very Very VERY good") and not one(spark, f, t="very very good") and one(spark, f, t="é é é")


def test_first_unsafe_pattern_is_reported(spark):
    f = filters.unsafe_reason(F.col("t"))
    assert one(spark, f, t="eval(1); open(2)") == filters.UNSAFE_PATTERNS[2]
    assert one(spark, f, t="x = 1") is None


def test_forbidden_calls(spark):
    f = X.forbidden_call(F.col("t"), F.array(F.lit(".sort("), F.lit("eval")))
    assert one(spark, f, t="a.sort (x)") == ".sort("
    assert one(spark, f, t="my_eval(x)") is None and one(spark, f, t="éeval(x)") is None
    assert one(spark, f, t="EVAL (x)") == "eval"


def test_script_markers_ignore_space(spark):
    assert one(spark, filters.script_reason(F.col("t")), t="Re quire ('fs')") == "require("


def test_substitution(spark):
    assert one(spark, X.substitute(F.col("t"), {"a b": "X", "b": "y"}), t="A b, b, cb") == "X, y, cb"
    # One pass: a value that holds a key is not replaced again; the first key that fits is taken.
    assert one(spark, X.substitute(F.col("t"), {"a": "the b", "b": "c"}), t="A b a") == "the b c the b"
    assert one(spark, X.substitute(F.col("t"), {"a": "1", "a b": "2"}), t="a b") == "1 b"
    got = one(spark, X.substitute_phrases(F.col("t"), (("a", "b"), ("b", "c"))), t="a x éa")
    assert got["text"] == "c x éa" and [h["source"] for h in got["hits"]] == ["a", "b"]


def test_tokens_are_restored(spark):
    f = X.restore_tokens(F.lit("O(n) and None, None != x"), F.col("t"), "Kept: ")
    assert one(spark, f, t="none here  ") == "none here\n\nKept: O(n), !=."
    assert one(spark, f, t="o(N) != none") == "o(N) != none"


def test_sets(spark):
    a, b = F.split(F.lit("a b c"), " "), F.split(F.lit("b c d"), " ")
    none = F.array().cast("array<string>")
    assert one(spark, X.jaccard(a, b)) == 0.5 and one(spark, X.jaccard(none, none)) == 1.0
    assert one(spark, X.overlap_f1(a, b)) == pytest.approx(2 / 3) and one(spark, X.overlap_f1(none, none)) == 0.0


def test_normalized_words_drop_plural_before_aliases(spark):
    f = X.normalized_words(F.col("t"), {"values": "x", "value": "number", "array": "list"}, ("the",))
    assert one(spark, f, t="The values of Arrays, bus") == ["number", "list", "bus"]


def test_anchors(spark):
    groups = ((("min", "least"), ("max",)),)
    f = X.anchors_kept(F.col("a"), F.col("b"), groups, ("not", "no"))
    assert one(spark, f, a="the min of 3", b="3 at least")
    assert not one(spark, f, a="the min of 3", b="3 at max")
    assert not one(spark, f, a="min 3", b="min 4") and not one(spark, f, a="not", b="so")


def test_format_graders(spark):
    f = X.grade_format(F.col("c"), F.col("t"), F.col("e"), F.array(F.lit("- a"), F.lit("- b")))
    g = lambda c, t, e="": one(spark, f, c=c, t=t, e=e)["reason"]
    assert g("exact_fence", "```python\nx=1\n```", "x=1") == "passed"
    assert g("exact_fence", "Hi ```python\nx=1\n```", "x=1") != "passed"
    assert g("exact_json", '{"a": 1, "b": [2]}', '{"a":1,"b":[2]}') == "passed"
    assert g("exact_json", '{"b": [2], "a": 1}', '{"a":1,"b":[2]}') == "JSON keys or values changed"
    assert g("exact_json", '```{"a":1}```', '{"a":1}') == "JSON was wrapped in Markdown"
    assert g("exact_json", "{", '{"a":1}') == "invalid JSON"
    assert g("exact_bullets", "- a\n- b\n") == "passed" and g("exact_bullets", "- a\n- b\nmore") != "passed"


def test_relocked(spark):
    f = X.relocked(F.col("p"), F.col("t"), r"^Do (.+?)\. Rest: .*$", r"\brest\s*:\s*", "It is {signature}: {requirement}")
    assert one(spark, f, p="Do f(a, b). Rest: x", t="abc REST : give it") == "It is f(a, b): give it"
    assert one(spark, f, p="other", t="abc") is None


def test_preflight_and_gate():
    assert PY.preflight("import os") == "import" and PY.preflight("eval('1')") == "call:eval" and PY.preflight("a.__b") == "dunder"
    assert PY.preflight("def f(:") == "syntax" and PY.preflight("x = 1") == ""
    assert PY.static_gate("import numpy") == "import:numpy" and PY.static_gate("import os") == "" and PY.static_gate("x == 1") == "no-effect"
    assert PY.static_gate('"""doc"""\nf()') == ""


def test_trims():
    assert PY.trim_python("def f():\n    return 1\n\nprint(f())\n") == "def f():\n    return 1"
    assert PY.trim_python("x = 1") is None and PY.trim_python("def (") is None
    assert PY.trim_script("function f() { return '}'; } // }\nf();") == "function f() { return '}'; }"
    assert PY.trim_script("f();") is None
    assert PY.mask_script("a = 'b{'; /* }\n */ c") == "a =     ;     \n    c"
    assert PY.mask_script("x = '{\\'{' + y") == "x = " + " " * 6 + " + y"


def test_normalizer():
    f = PY.normalizer({"en": "Done.", "sw": "Sawa kwa hii."}, {"sw": ("kwa", "hii")}, ("code",), (), "en")
    assert f("def f():\n    return 1\nprint(1)", "python", "en") == {"text": "```python\ndef f():\n    return 1\n```\n\nDone.", "actions": ["wrapped_bare_code", "removed_trailing_demo"]}
    again = f("```python\ndef f():\n    return 1\n```\n\nDone.", "python", "en")
    assert again["actions"] == []
    assert f("```python\nx\n```", "python", "sw")["actions"] == ["added_local_register"]
    assert f("just words", "python", "en") == {"text": "just words", "actions": []}


def test_contracts_and_markdown(spark):
    f = X.restore_contract(F.col("s"), F.col("t"), "Keep ", "Code:")
    got = one(spark, f, s="Use f( a ), f(a) and g(b).\n    def g(x):\n        return h(x)\n", t="ok g(b) \n")
    assert got["actions"] == ["restored_interface", "restored_source_code"] and got["text"] == "ok g(b)\n\nKeep f(a).\n\nCode:\n```\ndef g(x):\n    return h(x)\n```"
    assert tuple(one(spark, f, s="no calls", t="as is \n")) == ("as is \n", [])
    assert one(spark, f, s="async function f(a) {\r\n}", t="x")["text"] == "x\n\nCode:\n```\nasync function f(a) {\r\n}\n```"
    assert PY.map_markdown("## Why:\n\nabc\n\n```\nabc\n```", str.upper, {"Why": "Sababu"}) == "## Sababu\n\nABC\n\n```\nabc\n```"


def test_findings_come_from_the_outside_in():
    found = list(PY.findings("def f():\n    import os.path, numpy\n    x.__y\nopen(eval(1))\n"))
    assert [tuple(x) for x in found] == [("import", "os", 2), ("import", "numpy", 2), ("no-effect", "", 3), ("call", "open", 4), ("attribute", "__y", 3), ("call", "eval", 4)]
    deep = "x = " + "+".join(["a"] * 3000)
    assert PY.preflight(deep) in ("", "syntax")


def test_python_trims_end_with_whole_statements():
    assert PY.trim_python("def f(): pass\r\nx = 1") == "def f(): pass"
    assert PY.trim_python("def f(): pass; x = (1,\n 2)\nf()") == "def f(): pass; x = (1,\n 2)"
    assert PY.trim_python("x = 1\nclass A:\n    y = 2  # end\n\n\nA()") == "x = 1\nclass A:\n    y = 2  # end"


def test_udfs_keep_nulls(spark):
    df = spark.createDataFrame([("abc", "abd"), (None, "x")], "a string, b string")
    got = [r.r for r in df.select(PY.sequence_ratio_udf("a", "b").alias("r")).collect()]
    assert got == [difflib.SequenceMatcher(None, "abc", "abd").ratio(), None]


def test_mutants():
    code = "def f(x):\n    if x < 3 and x:\n        return x * 2 + 1\n    return None"
    made = PY.mutants(code)
    edits = [("x < 3 and x", "x < 3 or x"), ("return x * 2 + 1", "return None"), ("x < 3", "x <= 3"), ("2 + 1", "2 - 1")]
    assert sorted(made) == sorted(code.replace(*e) for e in edits)
    assert PY.mutants("def (") == [] and PY.mutants("x = 1") == []
    assert len(PY.mutants("\n".join(f"a{i} = {i} + b" for i in range(9)))) == 4


@pytest.mark.parametrize(("code", "want"), [
    ("function f() { return 1 }\nf()", "function f() { return 1 }"), ("function f() { if (x) { y } };  \nf()", "function f() { if (x) { y } };"),
    ("function f() { g({", None), ("const f = x => x", None), ("}\nfunction f() {}", "}\nfunction f() {}"), ("f()", None), ("class A { b() {} }\nnew A({", "class A { b() {} }"),
])
def test_script_trims_to_the_last_block(code, want):
    assert PY.trim_script(code) == want
