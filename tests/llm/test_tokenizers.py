import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuskiln.llm import sentencepieces as SP
from corpuskiln.llm import token_counts as TC

PARTS = ["a", " ", "  ", "\n", "'s", "é", "\xa0", "<|endoftext|>", "123", "!!", "word ", " \t", "日本", "x" * 9, "​", "\x1c", "the", "ing", "     ", "🙂"]


@pytest.fixture(scope="module")
def counter():
    return TC.Counter(TC.default_tokenizer())


@settings(deadline=None, max_examples=150)
@given(st.lists(st.sampled_from(PARTS), max_size=120))
def test_counts_equal_the_library(parts):
    c = TC.Counter(TC.default_tokenizer()) if not hasattr(test_counts_equal_the_library, "c") else test_counts_equal_the_library.c
    test_counts_equal_the_library.c = c
    text = "".join(parts)
    want = len(c.tokenizer.encode(text, add_special_tokens=False).ids)
    assert c.counts([text]) == [want]
    assert TC.count_spliced(c.tokenizer, text, chunk=16, overlap=4) == want


def test_text_without_a_stable_place(counter):
    text = "x" * 2000 + " y"
    assert TC.count_spliced(counter.tokenizer, text, 64, 8) == len(counter.tokenizer.encode(text).ids)


def test_huge_texts_and_a_full_memo():
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(20_000))
    c = TC.Counter(TC.default_tokenizer(), huge=1000, memo_entries=50)
    want = [len(c.tokenizer.encode(t, add_special_tokens=False).ids) for t in (text, "a b", text[:900])]
    assert c.counts([text, "a b", text[:900]]) == want and len(c.memo) <= 400


def test_count_tokens_on_edges(edge, edge_rows, empty, counter):
    got = sorted((tuple(r) for r in TC.count_tokens(edge, TC.default_tokenizer()).collect()), key=repr)
    want = [(r[0], len((r[1] or "").encode()), n, n > 1024) for r in edge_rows for n in [len(counter.tokenizer.encode(r[1] or "", add_special_tokens=False).ids)]]
    assert got == sorted(want, key=repr) and TC.count_tokens(empty, TC.default_tokenizer()).count() == 0


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=SP.default_model())


def ids(codec, text):
    return np.frombuffer(codec.encode([text])[0], "<i4").tolist()


@settings(deadline=None, max_examples=150)
@given(st.lists(st.sampled_from([p for p in PARTS if p != "<|endoftext|>"]), max_size=80))
def test_ids_equal_the_library(parts):
    import sentencepiece

    f = test_ids_equal_the_library
    if not hasattr(f, "pair"):
        f.pair = SP.Codec(SP.default_model()), sentencepiece.SentencePieceProcessor(model_file=SP.default_model())
    codec, lib = f.pair
    text = "".join(parts)
    got = ids(codec, text)
    assert got == lib.encode(text) and codec.decode(np.array(got, np.int64)) == text


def test_long_words(library):
    rng = random.Random(8)
    codec = SP.Codec(SP.default_model())
    for n in (127, 128, 129, 1000, 5000):
        text = "".join(rng.choice("thequickaeiou") for _ in range(n))
        assert ids(codec, text) == library.encode(text)
    assert ids(codec, " " * 300 + "x") == library.encode(" " * 300 + "x")


@pytest.mark.parametrize("alphabet", ["漢字仮名交じり文の長い列を試す語彙外𠮷𡈽", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "กขคงจฉชซฌญ", "theaoin", "é漢a\u200b"])
def test_unspaced_texts(library, alphabet, monkeypatch):
    """Texts without spaces are cut where no piece crosses, whatever the blocks, and give the library's ids."""
    rng = random.Random(len(alphabet))
    codec = SP.Codec(SP.default_model())
    for n in (129, 700, 4000):
        text = "".join(rng.choice(alphabet) for _ in range(n))
        for block in (1 << 18, 97):
            monkeypatch.setattr(SP, "BLOCK", block)
            codec.memo.clear()
            assert ids(codec, text) == library.encode(text)


def test_five_megabytes_without_a_space(library):
    rng = random.Random(5)
    text = "".join(rng.choice("漢字仮名交じり文の長い列を試す語彙外") for _ in range(1_700_000))
    start = time.process_time()
    got = ids(SP.Codec(SP.default_model()), text)
    assert time.process_time() - start < 30 and got == library.encode(text)


def best_score(word, scores, unknown):
    best = [0.0] + [-float("inf")] * len(word)
    for i in range(len(word)):
        found = False
        for j in range(i + 1, min(len(word), i + 16) + 1):
            if (s := scores.get(word[i:j])) is not None:
                found |= j == i + 1
                best[j] = max(best[j], best[i] + s)
        if not found:
            best[i + 1] = max(best[i + 1], best[i] + unknown)
    return best[-1]


def test_viterbi_matches_brute_force(library):
    p = SP.load(SP.default_model())
    scores = {library.id_to_piece(int(i)): float(s) for i, s in zip(p.ids, p.scores)}
    rng = random.Random(2)
    for n in (1, 2, 5, 9, 14):
        words = ["".join(rng.choice("▁thaeinrst日ঀ") for _ in range(n)) for _ in range(40)]
        found_ids, counts = SP.viterbi(SP.code_points(words), p)
        for word, found in zip(words, np.split(found_ids, np.cumsum(counts)[:-1])):
            pieces = [library.id_to_piece(int(i)) if i >= 0 else chr(-1 - i) for i in found]
            assert "".join(pieces) == word
            total = sum(scores[x] if i >= 0 else p.unknown_score for x, i in zip(pieces, found))
            assert total == pytest.approx(best_score(word, scores, p.unknown_score))


def test_encode_decode_on_edges(edge, edge_rows, empty, library):
    model = SP.default_model()
    encoded = SP.encode(edge, model, check=True).cache()
    got = sorted(((r.doc_id, r.text, list(r.ids), r.decoded) for r in encoded.collect()), key=repr)
    assert got == sorted(((r[0], r[1], library.encode(r[1] or ""), r[1] or "") for r in edge_rows), key=repr)
    assert sorted((r.text for r in SP.decode(encoded, model).collect())) == sorted(r[1] or "" for r in edge_rows)
    assert all(r.round_trip for r in SP.digests(encoded).collect()) and SP.encode(empty, model).count() == 0
    assert SP.Codec(model).decode(np.array(library.encode("a▁b"), np.int64)) == "a b"
