import hashlib
import random
import re

import numpy as np
import pytest

from corpuskiln.llm import automaton, secrets

BASE = (
    ("assign", re.compile(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
)
PARTS = ["password", "Token", "=", ":", " ", '"', "'", "a" * 5, "AKIA", "ABCDEF12345678", "0123456789abcdef", "\n", "é", "x", "secret", "api_key", "APIKEY", "deadbeef", "ghp_", "eyJabcd", ".", "-----BEGIN RSA PRIVATE KEY-----", "xoxb-", "A1" * 20]


def base_spans(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, p, g, least) in enumerate(BASE) for m in p.finditer(text) if m.end(g) - m.start(g) >= least]
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found)]


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 150))) for _ in range(n)]


@pytest.mark.parametrize("pattern", ["ab+c", "(a|bc)*d", "[a-c]{2,3}x?y", "(?i:Ab)c", "a{2,}b", "[^a]b", r"\.x\x20*=", "x(yz){2}"])
def test_automaton_finds_ends_of_matches(pattern):
    a, back = automaton.build([pattern]), automaton.build([pattern], backwards=True)
    rng = random.Random(7)
    for _ in range(200):
        text = "".join(rng.choice("abcdxyzABC.= \n") for _ in range(rng.randint(1, 40)))
        data = np.frombuffer(text.encode(), np.uint8)
        whole = [(i, j) for i in range(len(text)) for j in range(i + 1, len(text) + 1) if re.fullmatch(pattern, text[i:j])]
        places, masks = automaton.scan(a, data, 4)
        assert list(places) == sorted({j - 1 for _, j in whole}) and (masks == 1).all()
        places, _ = automaton.scan(back, data[::-1], 4)
        assert sorted(len(text) - 1 - places) == sorted({i for i, _ in whole})


def test_masks_tell_the_patterns_apart():
    a = automaton.build(["ab", "b+", "cab"])
    places, masks = automaton.scan(a, np.frombuffer(b"cabb a b", np.uint8), 3)
    assert list(zip(places.tolist(), masks.tolist())) == [(2, 7), (3, 2), (7, 2)]


def test_pieces_take_over_their_predecessors_state():
    a = automaton.build(["x{30}"])
    data = np.frombuffer(b"y" * 7 + b"x" * 30 + b"y" * 20, np.uint8)
    assert list(automaton.scan(a, data, 8)[0]) == [36]
    assert list(automaton.scan(a, np.frombuffer(b"x" * 1000, np.uint8), 8)[0]) == list(range(29, 1000))


def expected(text):
    """(start, rule number, end) by the expressions themselves."""
    found = [(m.start(), k, m.end()) for k, (_, p, g, least) in enumerate(BASE) for m in p.finditer(text) if m.end(g) - m.start(g) >= least]
    for k, rule in enumerate(secrets.RULES):
        if rule.kind not in secrets.BASE:
            found += [(m.start(), k, m.end()) for m in re.finditer(rule.pattern, text) if m.end() - m.start() >= rule.least]
    return sorted(found)


def test_spans_equal_the_expressions_on_whole_texts():
    s = secrets.scanner()
    for seed in range(60):
        texts = random_texts(5, seed)
        for text, found in zip(texts, s.spans([t.encode() for t in texts])):
            assert found == expected(text)
            kept = [f"{secrets.RULES[k].kind}:{a}:{b}" for a, k, b in found if secrets.RULES[k].kind in secrets.BASE]
            assert kept == base_spans(text)


def test_very_long_texts():
    rng = random.Random(4)
    texts = ["".join(rng.choices(PARTS, k=400_000)), "0123456789abcdef" * 20_000, "password=" + "b" * 300_000, "x" * 3_000_000]
    for text, found in zip(texts, secrets.scanner().spans([t.encode() for t in texts])):
        assert found == expected(text)


def test_query_columns(spark, edge, edge_rows, empty):
    rows = [(r[0], r[1]) for r in edge_rows] + [(1000 + i, t) for i, t in enumerate(random_texts(40, 99))]
    got = secrets.find_secrets(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string")).collect()
    want = []
    for i, t in rows:
        b = base_spans(t or "")
        want.append((i, *(sum(x.startswith(k + ":") for x in b) for k in ("assign", "access", "hex")), hashlib.sha256(",".join(b).encode()).hexdigest()))
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    assert secrets.find_secrets(empty).count() == 0


def test_redaction(spark, edge):
    text = "é password = abcdefghijklmnop and AKIA" + "A1" * 8 + " end"
    df = spark.createDataFrame([(1, text, len(text)), (2, None, None), (3, "clean", 99)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in secrets.redact(df).collect()}
    assert got[1] == ("é [assign] and [access] end", 27) and got[2] == (None, None) and got[3] == ("clean", 99)
    assert secrets.redact(edge).count() == edge.count()
