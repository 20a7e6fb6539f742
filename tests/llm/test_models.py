"""Decontamination, toxicity and the n-gram trie."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from specloom.llm import decontaminate, ngram, toxicity

from .conftest import words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- decontamination


def similarities(rows, items):
    """The best weighted similarity of any item-sized window, by trying all."""
    grams = lambda t: (lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)]) if w else Counter())(WORD.findall((t or "").lower()))
    out = {}
    for d, t in rows:
        w = WORD.findall((t or "").lower())
        seq = [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []
        for i, x in items:
            want = grams(x)
            n = sum(want.values())
            best = 0
            for s in range(max(1, len(seq) - n + 1) if n and seq else 0):
                have = Counter(seq[s : s + n])
                both = sum((have & want).values())
                best = max(best, both / (n + sum(have.values()) - both))
            if best >= 0.75:
                out[d, i] = max(best, out.get((d, i), 0))
    return out


def leak_rows(rng):
    items = [(k, words(rng, rng.randint(14, 60))) for k in range(30)] + [(50, "two words"), (51, ""), (52, None), (53, "the the the the the the the"), (54, words(rng, 400))]
    rows = [(k, words(rng, 80)) for k in range(10)]
    for k in range(30):
        w = items[k][1].split()
        rows.append((100 + k, words(rng, 20) + " " + " ".join(w).upper() + " " + words(rng, 20)))
        w[len(w) // 2] = "changed"
        rows.append((200 + k, words(rng, 20) + "\n" + "  ".join(w)))
        rows.append((300 + k, " ".join(items[k][1].split()[2:])))
    rows += [(400, "Two words"), (401, "has two words inside"), (402, None), (403, ""), (404, words(rng, 3000) + " " + items[3][1] + " " + words(rng, 3000)), (405, "the " * 50), (406, dict(items)[54]), (None, items[1][1]), (407, items[2][1]), (407, items[2][1])]
    return rows, items


def test_matches_agree_with_all_windows(spark, make, rng):
    rows, items = leak_rows(rng)
    bench = spark.createDataFrame([(i, x, "clash") for i, x in items], "item_id long, text string, doc_id string")
    got = decontaminate.matches(make(rows), bench).collect()
    want = similarities(rows, items)
    assert {(r.doc_id, r.item_id) for r in got} == set(want) and (400, 50) in want and (401, 50) not in want
    texts = dict(rows)
    for r in got:
        assert abs(r.similarity - want[r.doc_id, r.item_id]) < 1e-12 and r.distance <= decontaminate.RADIUS
        assert len(texts[r.doc_id].encode()[r.start_byte : r.end_byte].split()) == r.n_words
    docs = make(rows)
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, _ in rows} - {d for d, _ in want if d is not None}


def test_items_in_blocks(spark, make, rng, monkeypatch):
    rows, items = leak_rows(rng)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {(r.doc_id, r.item_id) for r in decontaminate.matches(make(rows), bench).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 10)
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(make(rows), bench).collect()} == want
    assert decontaminate.matches(make(rows), bench.where("false")).count() == 0 and decontaminate.matches(make(rows).where("false"), bench).count() == 0


def test_repeated_and_very_long_items(spark, make, rng, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 16)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 4000)
    x, long = words(rng, 30), words(rng, 2000)
    items = [(k, x) for k in range(40)] + [(100, long)] + [(200 + k, words(rng, 20)) for k in range(60)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    blocks = list(decontaminate._blocks(bench.selectExpr("item_id AS id", "text AS x"), 16, 4000))
    assert sorted(i for b in blocks for i, _ in b) == sorted(i for i, _ in items) and max(map(len, blocks)) <= 16
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(make([(1, f"a b {x} c"), (2, long), (3, items[50][1])]), bench).collect()}
    assert got == {(1, k) for k in range(40)} | {(2, 100), (3, items[50][0])}


def test_multi_index_finds_all_within_the_radius(rng):
    items = decontaminate.Items([(k, words(rng, 20)) for k in range(50)])
    g = np.random.default_rng(3)
    prints = items.prints[g.integers(0, 50, 400)].copy()
    for p in prints:  # up to 60 flipped bits
        for b in g.choice(128, g.integers(0, 60), replace=False):
            p[b // 64] ^= np.uint64(1 << (int(b) % 64))
    w, i, d = items.within(prints)
    all_d = np.bitwise_count(prints[:, None, :] ^ items.prints[None]).sum(2)
    assert set(zip(w.tolist(), i.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(all_d <= decontaminate.RADIUS))))
    assert (all_d[w, i] == d).all()


# --- toxicity


def labelled(rng, n=600):
    rows = []
    for k in range(n):
        sents = [words(rng, rng.randint(3, 10)) for _ in range(rng.randint(1, 8))]
        toxic = rng.random() < 0.3
        if toxic:
            s = rng.randrange(len(sents))
            sents[s] = f"{sents[s]} {rng.choice(['grobbish', 'grobbing', 'vilezz'])} {words(rng, 2)}"
        rows.append((k, ". ".join(sents) + ".", int(toxic)))
    return rows


def test_toxicity_is_learnt_from_documents_and_located(spark, make, rng):
    rows = labelled(rng)
    docs = make([(d, t) for d, t, _ in rows] + [(1000, None), (1001, ""), (1002, "..."), (None, "vilezz"), (1003, "a " * 30_000 + "vilezz. b"), (5, rows[5][1])])
    labels = spark.createDataFrame([(d, y) for d, _, y in rows] + [(3, None), (rows[7][0], rows[7][2])], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [(d, t, y) for d, t, y in rows if zlib.crc32(str(d).encode()) % 5 == 0]
    assert sum((got[d].score >= 0.5) == y for d, _, y in held) >= 0.95 * len(held)
    found = [t.encode()[got[d].worst_start : got[d].worst_end].decode() for d, t, y in held if y]
    assert sum("grobb" in s or "vilezz" in s for s in found) >= 0.9 * len(found)
    assert got[1000].score == got[1001].score == got[1002].score == 0 and got[1000].worst_start == -1 and got[1003].score > 0.5 and got[None].score > 0.5
    kept = toxicity.drop(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, r in got.items() if r.score < 0.5}
    assert toxicity.score(docs.where("false"), model).count() == 0
    again = toxicity.fit(docs, labels)
    assert (again.places == model.places).all() and np.allclose(again.weights, model.weights)


def test_scores_are_a_noisy_or_of_sentences(spark, make, rng):
    """The score of a text from the model's weights, sentence by sentence, in plain Python."""
    rows = labelled(rng, 300)
    model = toxicity.fit(make([(d, t) for d, t, _ in rows]), spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, toxic int"))
    weight = dict(zip(model.places.tolist(), model.weights.tolist()))
    texts = [t for _, t, _ in rows[:60]] + ["Vilezz! vilezz vilezz. grobbish", "a\n\nb. .. !?", "GROBBISH grobbing vilezzz"]
    got = {r.doc_id: r for r in toxicity.score(make(list(enumerate(texts))), model).collect()}
    for k, t in enumerate(texts):
        miss = 1.0
        for sentence in re.split(r"[.!?\n]", t):
            if not re.search(r"[A-Za-z0-9]", sentence):
                continue
            _, _, raw, offs = next(toxicity._text.chunks(pa.array([sentence])))
            own = set(toxicity.features(toxicity._text.words(raw, offs, toxicity._SEP)).ravel().tolist())
            miss *= 1 - 1 / (1 + math.exp(-(model.bias + sum(weight.get(f, 0) for f in own))))
        assert abs(got[k].score - (1 - miss)) < 1e-5, t


def test_a_repeated_document_is_fitted_once(spark, make, rng):
    rows = labelled(rng, 200)
    labels = spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, toxic int")
    plain = toxicity.fit(make([(d, t) for d, t, _ in rows]), labels)
    many = toxicity.fit(make([(d, t) for d, t, _ in rows] + [(rows[3][0], rows[3][1])] * 3000), labels)
    assert (plain.places == many.places).all() and np.allclose(plain.weights, many.weights)


def test_structured_words_are_known_apart(spark, make):
    a = "".join("ab"[bin(k).count("1") & 1] for k in range(1024))
    b = a.translate(str.maketrans("ab", "ba"))
    model = ngram.train(make([(1, f"x {a} y")]))
    got = {r.doc_id: r.n_known for r in ngram.score(make([(1, a), (2, b)]), model).collect()}
    assert got == {1: 2, 2: 1}
    found = decontaminate.matches(make([(1, f"v w {a} x y z"), (2, f"v w {b} x y z")]), spark.createDataFrame([(7, f"w {a} x y z")], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id) for r in found] == [(1, 7)]


def test_toxicity_without_both_labels(spark, make):
    docs = make([(1, "a b"), (2, "c")])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {0.0}
    one = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, one)).collect()} == {1.0}


def test_scores_do_not_read_ids_or_sources(spark, make, rng):
    rows = labelled(rng, 200)
    docs = make([(d, t) for d, t, _ in rows])
    model = toxicity.fit(docs, spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, toxic int"))
    a = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    b = {r.doc_id - 5000: r.score for r in toxicity.score(make([(d + 5000, t) for d, t, _ in rows]), model).collect()}
    assert a == b


# --- n-gram trie


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=300), st.integers(0, 3))
def test_elias_fano(values, many):
    v = np.sort(np.array(values + values[:1] * 100 * many, np.uint64))
    unique = np.unique(v)
    e = ngram.EliasFano.build(v, (1 << 40) + 1)
    assert (e.get(np.arange(len(v))) == v).all()
    e = ngram.EliasFano.load(ngram.EliasFano.build(unique, (1 << 40) + 1).arrays())
    assert (e.find(unique) == np.arange(len(unique))).all()
    absent = np.setdiff1d(unique + np.uint64(1), unique)
    assert (e.find(absent) == -1).all()


@pytest.mark.parametrize("n", [1, 63, 64, 65, 5000])
def test_elias_fano_dense_runs(n):
    v = np.concatenate([np.arange(n, dtype=np.uint64) + np.uint64(1 << 20), np.array([1 << 38], np.uint64)])
    e = ngram.EliasFano.build(v, 1 << 39)
    assert (e.get(np.arange(n + 1)) == v).all() and (e.find(v) == np.arange(n + 1)).all()
    assert (e.find(np.array([0, (1 << 20) - 1, (1 << 20) + n, (1 << 39) - 1], np.uint64)) == -1).all()


class Plain:
    """The same smoothing over dictionaries, without compact arrays or quantisation."""

    def __init__(self, texts, order=3, least=1):
        self.order, self.uni, self.n = order, Counter(), {2: Counter(), 3: Counter()}
        for w in texts:
            t = [*w, "</s>"]
            self.uni.update(t)
            for k, x in enumerate(t):
                before = t[k - 1] if k else "</s>"
                self.n[2][(before,), x] += 1
                if k:
                    self.n[3][(t[k - 2] if k > 1 else "</s>", before), x] += 1
        self.total, self.size = sum(self.uni.values()), len(self.uni)
        self.kept = {k: {g: c for g, c in self.n[k].items() if c >= least and all(self.uni[x] >= least for x in (*g[0], g[1]))} for k in range(2, order + 1)}
        if order == 3:
            self.kept[3] = {g: c for g, c in self.kept[3].items() if (g[0][:1], g[0][1]) in self.kept[2]}
        self.left = {}
        for k in range(2, order + 1):
            seen = Counter()
            for (ctx, _), c in self.kept[k].items():
                whole = self.uni[ctx[0]] if k == 2 else self.n[2][ctx[:1], ctx[1]]
                seen[ctx] += (c - ngram.DISCOUNT) / whole
            self.left[k] = {ctx: max(1 - s, 1e-6) for ctx, s in seen.items()}

    def base(self, x):
        return (self.uni[x] + 1) / (self.total + self.size + 1)

    def p(self, ctx, x):
        if not ctx:
            return self.base(x)
        k = len(ctx) + 1
        if ctx in self.left.get(k, {}):
            left = self.left[k][ctx]
            if (ctx, x) in self.kept[k]:
                whole = self.uni[ctx[0]] if k == 2 else self.n[2][ctx[:1], ctx[1]]
                return (self.kept[k][ctx, x] - ngram.DISCOUNT) / whole + left * self.p(ctx[1:], x)
            return left * self.p(ctx[1:], x)
        return self.p(ctx[1:], x)

    def score(self, w):
        t, out = [*w, "</s>"], 0.0
        for k, x in enumerate(t):
            ctx = ("</s>",) if k == 0 else (t[k - 2] if k > 1 else "</s>", t[k - 1])[3 - self.order :]
            out += math.log10(self.p(ctx, x))
        return out


def prose(rng, n):
    vocab = [words(rng, 1) for _ in range(40)]
    return [" ".join(vocab[min(int(rng.expovariate(0.15)), 39)] for _ in range(rng.randint(1, 60))) for _ in range(n)]


def wide(level):
    level.widest = 1 << 50
    return level


@pytest.mark.parametrize("order, least, cut, fits", [(3, 1, 60, True), (3, 1, 60, False), (2, 1, 200, True), (3, 2, 500, True), (3, 1, 10**6, True)])
def test_trie_agrees_with_dictionaries(spark, make, rng, monkeypatch, order, least, cut, fits):
    train = prose(rng, 120) + [None, "", "Same Same same"]
    test = prose(rng, 20) + [None, "", "never seen at all", "same  same same", "x " * 20_000]
    rows = list(enumerate(train + test))
    if not fits:  # keys and shards that do not fit in one number of 64 bits
        made = ngram._index
        monkeypatch.setattr(ngram, "_index", lambda *a: wide(made(*a)))
    model = ngram.train(make(rows[: len(train)]), order=order, least=least, shard_tokens=cut)
    if cut < 10**6:  # several shards in each level, and frequent words with several of their own
        assert all(len(x.listed["file"]) > 1 for x in model.levels) and model.vocabulary.hot
    plain = Plain([WORD.findall((t or "").lower()) for t in train], order, least)
    got = {r.doc_id: r for r in ngram.score(make(rows), model).collect()}
    for d, t in rows:
        w = WORD.findall((t or "").lower())
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w) + 1, sum(plain.uni[x] > 0 for x in w) + 1, plain.total)
        assert abs(r.base_score - sum(math.log10(plain.base(x)) for x in [*w, "</s>"])) < 1e-6
        assert abs(r.score - plain.score(w)) <= 2 * ngram.STEP * (len(w) + 1) + 1e-6, t
    assert 0.9 < sum(plain.p(("</s>",), x) for x in plain.uni) <= 1


@pytest.mark.parametrize("cut, packed", [(60, True), (60, False), (10**6, True)])
def test_trie_seeks_each_key_once(spark, make, rng, monkeypatch, cut, packed):
    texts = prose(rng, 60)
    model = ngram.train(make(list(enumerate(texts))), shard_tokens=cut)
    if not packed:  # contexts whose numbers leave no room beside the place
        monkeypatch.setattr(ngram, "_order", lambda c, s, *_, made=ngram._order: made(c, s, 1 << 62, 1 << 62))
    scores, keys, find = {}, [], ngram.EliasFano.find
    monkeypatch.setattr(ngram.EliasFano, "find", lambda self, x: keys.append(len(x)) or find(self, x))
    for times in (1, 50):  # fifty copies of all texts, in one run of the operator, need no more searches than one
        keys.clear()
        got = []
        for h, first in ngram._chunks(pa.array((texts + ["never seen", ""]) * times)):
            ids, n = model.words(h)
            *_, p = model.walk(ids, first[:-1], model.base(n))
            got += np.add.reduceat(p, first[:-1]).tolist()
        scores[times] = got, sum(keys)
    assert np.allclose(scores[50][0], scores[1][0] * 50, atol=1e-9)
    assert scores[50][1] == scores[1][1] or not packed


def test_tokens_of_several_chunks_are_one_run(rng, monkeypatch):
    texts = pa.array([*prose(rng, 50), None, "", "x " * 3_000] * 40)
    whole = [(h.tolist(), first.tolist()) for h, first in ngram._chunks(texts)]
    assert len(whole) == 1
    monkeypatch.setattr(ngram, "TOGETHER", 1)
    cut = ngram._text.chunks
    monkeypatch.setattr(ngram._text, "chunks", lambda column, size: cut(column, 1 << 10))
    small = list(ngram._chunks(texts))
    assert len(small) > 100
    assert np.concatenate([h for h, _ in small]).tolist() == whole[0][0]
    assert np.concatenate([np.diff(first) for _, first in small]).tolist() == np.diff(whole[0][1]).tolist()
    joined = ngram._joined(small)
    assert (joined[0].tolist(), joined[1].tolist()) == whole[0]


def test_select_in_word(rng):
    numbers = [1, 1 << 63, (1 << 64) - 1, *(rng.getrandbits(64) & rng.getrandbits(64) | 1 for _ in range(200))]
    for x in numbers:
        at = [j for j in range(64) if x >> j & 1]
        got = ngram._select_in_word(np.full(len(at), x, np.uint64), np.arange(len(at)))
        assert got.tolist() == at


def test_low_bits_of_every_width(rng):
    for bits in (1, 2, 7, 16, 31, 33, 47, 58):
        values = np.unique(np.array([rng.getrandbits(bits + 5) for _ in range(700)], np.uint64))
        coded = ngram.EliasFano.build(values, 1 << (bits + 5))
        assert (coded.get(np.arange(len(values))) == values).all()
        assert (coded.find(values) == np.arange(len(values))).all()
        others = np.setdiff1d(values ^ np.uint64(1), values)
        assert (coded.find(others) == -1).all()


def test_trie_of_nothing(spark, make):
    empty = make([(1, "a")]).where("false")
    model = ngram.train(empty)
    r = ngram.score(make([(1, "a b")]), model).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)
    assert ngram.score(empty, model).count() == 0


def test_runs_round_trip():
    keys, n = np.array([3, 3 << 40, (3 << 40) + 1], np.uint64), np.array([1, 70000, 2])
    k, c = ngram._unrun(ngram._runs(keys, n))
    assert (k == keys).all() and (c == n).all()
    assert pa.array(k).to_pylist() == keys.tolist()
