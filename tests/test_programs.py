"""The queries over programs made of whole texts, against other versions over all rows."""

import ast
import hashlib
import re
import sys
import textwrap

import pytest
from hypothesis import given
from hypothesis import strategies as st

from corpuskiln.functions import python_code as PY
from corpuskiln.plans import catalogue, programs
from corpuskiln.plans import settings as S


@pytest.fixture(scope="module")
def python(spark, sf):
    return [(r.doc_id, r.entry, r.code) for r in programs.python_programs(spark, sf).collect()]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def rows(spark, sf, name):
    return {r[0]: tuple(r)[1:] for r in catalogue.QUERIES[name](spark, sf).collect()}


def parsed(code):
    try:
        return ast.parse(code)
    except (SyntaxError, ValueError):
        return None


def test_findings(spark, sf, python):
    want = {}
    for i, _, code in python:
        tree = parsed(code)
        if tree is None:
            want[i] = ("syntax", "syntax", False)
            continue
        # Imports stand above everything else, then what the function's body holds.
        imported = re.search(r"^(?:import (\w+)|from sys import (path))", code, re.M)
        call, dunder, idle = (re.search(x, code, re.M) for x in (r"^    (eval)\(", r"^    \w+\.__\w*$", r"^(?:    ){1,2}(?!return$)\w+(?:\.\w+| == 1)?$"))
        names = [imported[1] or imported[2]] if imported else []
        early = "import" if names else "call:eval" if call else "dunder" if dunder else ""
        late = f"import:{names[0]}" if names and names[0] not in sys.stdlib_module_names else "no-effect" if idle else ""
        want[i] = (early, late, True)
    assert rows(spark, sf, "program_findings") == want
    assert {w[0] for w in want.values()} == {"", "syntax", "import", "call:eval", "dunder"} and {w[1][:6] for w in want.values()} == {"", "syntax", "import", "no-eff"}


def test_contracts(spark, sf, python, docs):
    want = {}
    for i, entry, code in python:
        whole = parsed(code) is not None
        b, c, e = re.search(r"^def \w+\((\w+): int, (\w+)=None, \*(\w+): str\)", code, re.M).groups() if whole else ("", "", "")
        requirement = " ".join(docs[i].text.split())
        names = ", ".join(sorted(set(re.findall(r"(?m)^\s*(?:def|class)\s+([A-Za-z_]\w*)", code))))
        want[i] = (f"{entry}({b}, {c}=None, *{e})", requirement, names) if whole and requirement else (None, None, names)
    assert rows(spark, sf, "program_contracts") == want and any(w[0] for w in want.values())


def test_trims(spark, sf, python):
    for i, (trimmed, text, actions) in rows(spark, sf, "program_trims").items():
        code = next(c for j, _, c in python if j == i)
        tree = parsed(code)
        assert (trimmed is None) == (tree is None)
        if tree:
            # A program that was cut off has no demonstration.
            demo = re.search(r"\n\s*print\(\w+\(1\)\)\s*\Z", code)
            assert trimmed == (code[: demo.start()] if demo else code).rstrip()
            fence = "```python\n" + trimmed + "\n```\n\nDone."
            assert (text, actions) == (fence, "wrapped_bare_code" + ",removed_trailing_demo" * (trimmed != code.strip())) or "```" in code
        elif "```" not in code:
            assert (text, actions) == (code.strip(), "")


def test_mutants(spark, sf, python):
    got = {}
    for r in catalogue.QUERIES["program_mutants"](spark, sf).collect():
        got.setdefault(r.doc_id, []).append((r.ordinal, r.mutant))
    for i, _, code in python:
        tree = parsed(code)
        if tree is None:
            assert i not in got
            continue
        if not code.endswith("(1))\n"):
            continue  # cut off
        lines = ast.unparse(tree).split("\n")
        at = max(k for k, x in enumerate(lines) if re.fullmatch(r"    if \w+ < \d+ and \w+:", x))
        end = max(k for k, x in enumerate(lines) if x.startswith("    return "))
        put = lambda k, x: "\n".join([*lines[:k], x, *lines[k + 1 :]])
        want = [put(end, "    return None"), put(at, lines[at].replace(" and ", " or ")), put(at + 1, "        return None")]
        extra = [k for k in range(at, end) if re.fullmatch(r"    \w+ == 1", lines[k])]
        want.append(put(extra[0], lines[extra[0]].replace("==", "!=")) if extra else put(at, lines[at].replace(" < ", " <= ")))
        assert [m for _, m in sorted(got[i])] == want, i


@given(st.text("a{}'\"`\\/*\n ", max_size=30))
def test_masks_of_any_text(code):
    assert PY.mask_script(code) == mask_by_states(code)


def mask_by_states(code):
    """The same by a table of states: what each state does with the next characters."""
    out, state, k = "", "code", 0
    while k < len(code):
        c, two = code[k], code[k : k + 2]
        if state == "code":
            state = {"//": "line", "/*": "block"}.get(two) or (c if c in "\"'`" else "code")
            size = 2 if state in ("line", "block") else 1
            out += c if state == "code" else " " * size
        elif state == "line":
            size, state = 1, "code" if c == "\n" else "line"
            out += "\n" if c == "\n" else " "
        elif state == "block":
            size, state = (2, "code") if two == "*/" else (1, "block")
            out += "\n" if c == "\n" else " " * size
        else:
            size = len(two) if c == "\\" else 1
            out += "\n" if c == "\n" else " " * size
            state = "code" if c == state else state
        k += size
    return out


def test_script_masks(spark, sf):
    code = {r.doc_id: r.code for r in programs.script_programs(spark, sf).collect()}
    got = rows(spark, sf, "script_masks")
    assert got.keys() == code.keys()
    for i, (mask, trimmed) in got.items():
        assert mask == mask_by_states(code[i])
        # The last block is the arrow function's, or what the text's own quotes make of it.
        assert trimmed is None or code[i].startswith(trimmed)
        if not set("'`") & set(code[i].split("*/")[0]):
            assert trimmed.endswith("`; };") and mask[: len(trimmed)].count("{") == mask[: len(trimmed)].count("}")


def test_markdown(spark, sf, docs):
    got = rows(spark, sf, "markdown_texts")
    for i, r in docs.items():
        if "```" not in r.text and r.text.strip():
            up = "".join(p if not p.strip() else p.replace(p.strip(), p.strip().upper(), 1) for p in re.split(r"(\n\s*\n)", r.text))
            assert got[i][0] == f"# Hinweise\n\n{up}\n\n```py\n{r.text}\n```\n\nEnde\n\n{up}".strip()


def test_translated_contracts(spark, sf, docs, python):
    first = {}
    for i in sorted(docs):
        first.setdefault((docs[i].source, docs[i].lang), docs[i].text)
    got = rows(spark, sf, "translated_contracts")
    for i, entry, code in python:
        d = docs[i]
        model = first[d.source, d.lang]
        given = f"{d.text} Call {entry}( x ) now.\n  " + code.replace("\n", "\n  ")
        hits, x = [], given
        for phrase, value in S.PHRASES:
            x, n = re.subn(rf"(?<!\w){re.escape(phrase)}(?!\w)", value, x, flags=re.I)
            hits += [f"{phrase}>{value}"] * (n > 0)
        m = re.search(r"(?ms)^(?P<block>[ \t]*def\s+[A-Za-z_]\w*\s*\([^\n]*\)\s*:.*)$", given)
        prose = given[: m.start()] if m else given
        calls = {f"{n}({a.strip()})": 0 for n, a in re.findall(r"(?<![.\w])([A-Za-z_$][\w$]*)\s*\(([^()\n]*)\)", prose)}
        lost = [c for c in calls if c not in model]
        parts = ([f"Signature: {', '.join(lost)}."] if lost else []) + ([f"Code:\n```\n{textwrap.dedent(m['block']).rstrip()}\n```"] if m else [])
        want = "\n\n".join([model.rstrip(), *parts]) if parts else model
        actions = hits + ["restored_interface"] * bool(lost) + ["restored_source_code"] * bool(m)
        assert got[i] == (hashlib.sha256(x.encode()).hexdigest(), want, ",".join(actions)), i


def test_register_chain(spark, sf, docs):
    got = rows(spark, sf, "register_chain")
    table = {k.lower(): v for k, v in S.SUBSTITUTES.items()}
    for i, r in docs.items():
        text = re.sub(r"(?i)\b(?:" + "|".join(S.SUBSTITUTES) + r")\b", lambda m: table[m[0].lower()], r.text) if i % 2 == 0 else r.text
        kind = "code" if r.n_chars > 800 else "explanation"
        more = {("de", "code"): "\n\nAntworte kurz.", ("fr", "explanation"): "\n\nExplique."}.get((r.lang, kind), "")
        assert got[i] == (r.lang, text + more)


def test_compiled_grades(spark, sf, python):
    got = rows(spark, sf, "compiled_grades")
    want = {}
    for i, _, code in python:
        exact = re.fullmatch(r"```python\n(.*?)\n?```", f"```python\n{code}{'#' if i % 3 == 0 else ''}\n```", re.S)
        if not exact:
            want[i] = "response"
        elif i % 3 == 0:
            want[i] = "code changed while copying"
        else:
            want[i] = "passed" if PY.compiles_whole(code) else "copied code does not compile"
    assert {i: g[1] if g[1].startswith(("code", "copied", "passed")) else "response" for i, g in got.items()} == want and len(set(want.values())) >= 3
    assert PY.compiles("def f(a, a): pass") and not PY.compiles_whole("def f(a, a): pass")
