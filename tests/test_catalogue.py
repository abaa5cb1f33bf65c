"""Every query of the catalogue against its SQL, over the smallest tables."""

import re
from difflib import SequenceMatcher
from itertools import combinations
from pathlib import Path

import duckdb
import pytest

from corpuskiln.functions import text
from corpuskiln.plans import catalogue
from corpuskiln.plans import settings as S

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return round(x, 9)
    return list(x) if isinstance(x, (list, tuple)) else x


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, db, sf, name):
    df = catalogue.QUERIES[name](spark, sf)
    want = db.sql(catalogue.SQL[name])
    got = table(df.columns, [tuple(r) for r in df.collect()])
    assert got == table(want.columns, want.fetchall())


@pytest.fixture(scope="module")
def docs(db):
    return db.sql("SELECT doc_id, text, lang, source FROM documents").fetchall()


def rows(spark, sf, name):
    return [tuple(r) for r in catalogue.QUERIES[name](spark, sf).collect()]


def normal(text):
    """The words of a text as the catalogue normalises them."""
    found = re.findall(r"[^\W\d_]{3,}", text.lower().replace("ß", "ss"))
    single = [w[:-1] if w.endswith("s") and len(w) > 4 else w for w in found]
    return {w for w in (S.ALIASES.get(w, w) for w in single) if w not in S.STOP}


def paraphrase(a, b):
    if (len(a & b) / len(a | b) if a | b else 1.0) >= 0.70:
        return True
    matcher = SequenceMatcher(None, " ".join(sorted(a)), " ".join(sorted(b)))
    return matcher.real_quick_ratio() >= 0.86 and matcher.quick_ratio() >= 0.86 and matcher.ratio() >= 0.86


def test_paraphrases_by_brute_force(spark, sf, docs, db):
    sets = {i: normal(x) for i, x, *_ in docs}
    want = {(i, j) for i, j in combinations(sorted(sets), 2) if paraphrase(sets[i], sets[j])}
    assert set(rows(spark, sf, "paraphrase_pairs")) == want and want
    seen = [normal(x) for (x,) in db.sql("SELECT text FROM benchmark").fetchall()]
    assert {i for (i,) in rows(spark, sf, "unseen_requirements")} == {i for i, a in sets.items() if not any(paraphrase(a, b) for b in seen)}


def test_phrases_by_brute_force(spark, sf, docs):
    want = []
    for i, x, *_ in docs:
        hits = []
        for phrase, value in S.PHRASES:
            x, n = re.subn(rf"(?<!\w){re.escape(phrase)}(?!\w)", value, x, flags=re.I)
            hits += [phrase] * (n > 0)
        want.append((i, x, ",".join(hits)))
    assert sorted(rows(spark, sf, "phrase_substitute")) == sorted(want)


def test_tokens_and_repeats_by_brute_force(spark, sf, docs):
    want = []
    for i, x, lang, source in docs:
        given = f"O(n) == None Python <= {source}"
        target = f"python {lang}" if i % 2 == 0 else given
        missing = [t for t in dict.fromkeys(re.findall(text.PROTECTED_TOKENS.replace("(?iU)", "(?i)"), given)) if t.lower() not in target.lower()]
        want.append((i, f"{target.rstrip()}\n\nKept: {', '.join(missing)}." if missing else target))
    assert sorted(rows(spark, sf, "token_restore")) == sorted(want)
    again = re.compile(r"\b([\w'-]+)(?:\s+\1){2,}\b", re.I)
    assert sorted(i for (i,) in rows(spark, sf, "repeated_word_collapse")) == sorted(i for i, x, *_ in docs if again.search(x))


def test_scores_and_mutants_by_brute_force(spark, sf, docs):
    token = re.compile(r"[a-z]+|[0-9]+(?:\.[0-9]+)?")
    first, want = {}, {}
    for i, x, lang, source in sorted(docs):
        a, b = (token.findall(y.lower().replace("ß", "ss")) for y in (x, first.setdefault((lang, source), x)))
        f1 = 2 * len(set(a) & set(b)) / max(1, len(set(a)) + len(set(b)))
        want[i] = (f1 + SequenceMatcher(None, " ".join(a), " ".join(b)).ratio()) / 2
    got = dict(rows(spark, sf, "semantic_score"))
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-4 for i in want)
    mutants = rows(spark, sf, "code_mutants")
    assert len(mutants) == 4 * len(docs) and all(f"x <= {i} " in m or f"x < {i} " in m for i, _, m in mutants)


def test_every_query_has_sql_or_a_test_here():
    here = "".join(p.read_text(encoding="utf-8") for p in Path(__file__).parent.glob("test_*.py"))
    assert all(f'"{name}"' in here for name in set(catalogue.QUERIES) - set(catalogue.SQL))
