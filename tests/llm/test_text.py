"""The word and hash kernel against plain Python."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from specloom.llm import _text

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("abAB é\t\n\v. ", max_size=30)), max_size=8), st.integers(1, 40))
def test_words_and_shingles(texts, chunk):
    got, sh = [], []
    for _, _, raw, offs in _text.chunks(pa.array(texts, pa.string()), chunk):
        w = _text.words(raw, offs)
        for a, b in zip(w.first[:-1], w.first[1:]):
            got.append([(bytes(raw[s:e]).decode().translate(LOWER), int(h)) for s, e, h in zip(w.start[a:b], w.end[a:b], w.hash[a:b])])
        s, first = _text.shingles(w)
        sh += [s[a:b].tolist() for a, b in zip(first[:-1], first[1:])]
    want = [WORD.findall((t or "").translate(LOWER)) for t in texts]
    assert [[x for x, _ in g] for g in got] == want
    by_word = {}
    for x, h in (p for g in got for p in g):
        assert by_word.setdefault(x, h) == h
    assert len(set(by_word.values())) == len(by_word)
    grams = {}
    for w, hs in zip(want, sh):
        own = [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []
        assert len(own) == len(hs)
        for g, h in zip(own, hs):
            assert grams.setdefault(g, h) == h
    assert len(set(grams.values())) == len(grams)


def test_reductions_skip_empty_ranges():
    first = np.array([0, 0, 2, 2, 3])
    assert _text.reduce_min(np.array([3, 1, 7]), first, 99).tolist() == [99, 1, 99, 7]
    assert _text.reduce_sum(np.array([3, 1, 7]), first).tolist() == [0, 4, 0, 7]


def thue_morse(n):
    return "".join("ab"[bin(k).count("1") & 1] for k in range(n))


def test_structured_words_do_not_collide():
    pairs = []
    for n in (16, 64, 256, 1024, 2048, 65536):
        a = thue_morse(n)
        pairs += [a, a.translate(str.maketrans("ab", "ba")), a + "b", "b" + a]
    _, _, raw, offs = next(_text.chunks(pa.array(pairs, pa.string())))
    assert len(set(_text.words(raw, offs).hash.tolist())) == len(pairs)
    s, first = _text.shingles(_text.words(raw, offs))
    assert len(set(s.tolist())) == len(pairs)
