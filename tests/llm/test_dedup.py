"""Near-duplicates, line dedup and substring dedup against brute force."""

import hashlib
import re
import time

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from specloom.llm import components, lines, neardup, substrings
from specloom.llm._runtime import Workspace

from .conftest import words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall((text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, s) in enumerate(sets):
        for j, t in sets[:k]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= 75 * len(s | t):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted((-1 if i is None else i, len(s), -1 if i is None else find(i)) for i, s in sets)


def near_rows(rng):
    base = words(rng, 60).split()
    rows = [(100 + k, words(rng, 30)) for k in range(20)]
    for k in range(40):  # copies with ever more edits: some linked to the first, some only to each other, some to none
        copy = list(base)
        for _ in range(k // 8):
            copy[rng.randrange(len(copy))] = "edit"
        rows.append((k, " ".join(copy)))
    tail = words(rng, 40)
    rows += [(200 + k, words(rng, 12) + " " + tail) for k in range(30)]  # a common passage that links nothing
    rows += [(300, None), (301, ""), (302, " \n"), (303, "one two"), (304, "One  two"), (305, "one"), (None, "one two"), (306, words(rng, 20_000)), (307, words(rng, 20_000))]
    rows += [(307, rows[-1][1]), (303, "one two")]
    return rows


def test_neardup_classes_match_brute_force(make, rng):
    rows = near_rows(rng)
    got = neardup.classes(make(rows)).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in got) == brute(rows)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


def test_neardup_in_small_blocks(make, rng, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rows = near_rows(rng)
    got = neardup.classes(make(rows)).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in got) == brute(rows)


def test_one_document_with_several_texts(make, rng):
    a, b, c = (words(rng, 40) for _ in range(3))
    rows = [(5, a), (5, b), (7, b + " tail"), (9, a), (3, c), (9, c), (2, None), (2, "x"), (11, words(rng, 40))]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in neardup.classes(make(rows)).collect())
    assert got == sorted(brute(rows)) and {x[2] for x in got if x[0] in (3, 5, 7, 9)} == {3}


def test_many_near_copies(make, rng):
    """One family of 10,000 texts that all share keys but fall into many classes."""
    tails = [words(rng, 14).split() for _ in range(40)]
    head = words(rng, 42)
    rows = [(k, f"{head} {' '.join(tails[k % 40])}{' end' if k % 3 else ''}") for k in range(10_000)]
    got = {r.doc_id: r.component_id for r in neardup.classes(make(rows)).collect()}
    distinct = {t: i for i, t in reversed(rows)}
    want = {i: c for i, _, c in brute(sorted((i, t) for t, i in distinct.items()))}
    assert all(got[i] == want[distinct[t]] for i, t in rows)


def test_structured_words(make):
    """Words that polynomial hashes modulo a power of two take for equal."""
    a = "".join("ab"[bin(k).count("1") & 1] for k in range(2048))
    b = a.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"one {a} two three four five"), (2, f"one {b} two three four five"), (3, f"one {a} two three four five")]
    assert {r.doc_id: r.component_id for r in neardup.classes(make(rows)).collect()} == {1: 1, 2: 2, 3: 1}
    got = substrings.dedup(make([(1, a), (2, b), (3, "x" + a)]), length=200, gram=40).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == repeated([(1, a), (2, b), (3, "x" + a)], 200, "none")


def test_a_large_component_does_not_meet_itself(spark, monkeypatch):
    """100 nodes of one component and 6 strays in blocks of 10: each text of the large one is copied once for each block of strays, not for each block."""
    monkeypatch.setattr(neardup, "BLOCK", 10)
    rows = [(k, 0, 0 if k < 100 else k, "x") for k in range(106)] + [(k, 500, 500 + k % 2, "y") for k in range(500, 507)] + [(k, 900, 900, "z") for k in range(900, 950)]
    told = spark.createDataFrame(rows, "node long, family long, component long, x string")
    got = neardup.deal(Workspace(spark, "test"), told).collect()
    copies = {k: sum(r.node == k for r in got) for k, *_ in rows}
    assert all(copies[k] == 1 for k in range(100)) and all(copies[k] == 11 or copies[k] == 12 for k in range(100, 106)) and not any(copies[k] for k in range(900, 950))
    groups = {}
    for r in got:
        groups.setdefault((r.family, r.i, r.j), []).append(r)
    met = {(a.node, b.node) for g in groups.values() for a in g for b in g}
    assert all((a, b) in met for a, fa, ca, _ in rows for b, fb, cb, _ in rows if fa == fb and ca != cb)


def test_neardup_dedup_keeps_columns(make, rng):
    rows = near_rows(rng)
    docs = make(rows)
    kept = neardup.dedup(docs)
    want = sum(i == c for i, _, c in brute(rows))
    assert kept.columns == docs.columns and kept.count() == want
    assert neardup.dedup(make(rows).where("false")).count() == 0 and neardup.classes(make(rows).where("false")).count() == 0


@pytest.mark.parametrize("part", [10**6, 30])
def test_components_of_chains_and_stars(spark, part):
    ws = Workspace(spark, "test")
    edges = [(i, i + 1) for i in range(50)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 199), (199, 200)]
    got = {r.node: r.component for r in components.components(ws, spark.createDataFrame(edges, "a long, b long"), part=part).collect()}
    assert {got[k] for k in range(51)} == {0} and {got[k] for k in range(100, 140)} == {100} and got[200] == got[199] == 199
    assert components.components(ws, spark.createDataFrame([], "a long, b long")).count() == 0


# --- lines


def line_rows(rng):
    run, long = [words(rng, 4) for _ in range(5)], words(rng, 50)
    text = lambda *x: "\n".join(x)
    solo = [words(rng, 3) for _ in range(30)]
    rows = [
        (1, text(solo[0], *run, solo[1])), (2, text(*run)), (3, text(run[0], run[1], solo[2], run[2], run[3])), (4, text(run[2], "", "  ", run[3], " " + run[4] + " ", solo[3])), (5, text(*run[1:4], *run[1:4])),
        (6, text("a", "a", "a", "a", "a")), (7, text("a", "b")), (8, ""), (9, None), (10, text(*run, *run)), (11, text(*(words(rng, 2) for _ in range(3000)))), (12, text(solo[4], *run[:3])), (0, text(run[1], run[2], run[3])), (13, "\n\n"), (14, "last\n"),
        (15, long), (16, text(solo[5], "  " + long + " ")), (17, text("\t" + long, solo[6])), (18, text(long[:-1] + "\x0b" + long[-1], "\t" + long)),
    ]
    return rows


def test_lines_match_sql(make, rng, tmp_path):
    rows = line_rows(rng)
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text or "") for r in lines.dedup(make(rows), counts=True).collect()}
    c = duckdb.connect()
    c.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = {i: (n, k, t) for i, n, k, t in c.sql(f"SELECT doc_id, n_lines, n_removed, text FROM ({lines.SQL})").fetchall()}
    assert got == want and got[2][1] == 5 and got[6][1] > 0 and got[3][1] == 0


def test_lines_odd_rows(make, rng):
    run = "\n".join(words(rng, 4) for _ in range(4))
    docs = make([(5, run), (5, run), (None, run), (7, None), (5, "x\n" + run)])
    out = lines.dedup(docs)
    assert out.columns == docs.columns
    # a null id comes first, and rows with equal id and text are one document
    assert sorted((str(r.doc_id), r.text) for r in out.collect()) == sorted([("None", run), ("5", ""), ("5", ""), ("5", "x"), ("7", None)])
    assert lines.dedup(docs.where("false")).count() == 0


def test_long_lines_are_runs_by_themselves(make, rng):
    long, short, other = words(rng, 50), words(rng, 49), words(rng, 60)
    w = lambda: words(rng, 5)
    rows = [(1, long), (2, f"{w()}\n{long}"), (3, f"{w()}\n{w()}\n\t{other}\n{w()}"), (4, f"{w()}\n{w()}\n {long} \n{w()}\n{short}"), (5, f"{short}\n{w()}"), (6, f"\t{other}"), (7, long), (8, f"{w()}\n{long}\n{w()}\n{long}"), (9, other)]
    seen, want = set(), {}
    for i, t in rows:
        kept = []
        for x in t.split("\n"):
            x, line = x.strip(" "), x
            if len(x.split()) >= 50 and x in seen:
                continue
            seen.add(x)
            kept.append(line)
        want[i] = "\n".join(kept)
    assert {r.doc_id: r.text for r in lines.dedup(make(rows)).collect()} == want and want[7] == "" and short in want[5]
    assert {r.doc_id: r.text for r in lines.dedup(make(rows), long_words=None).collect()} == dict(rows)


def test_one_text_of_very_many_lines(make, rng):
    many = "\n".join(words(rng, 2) + str(k) for k in range(150_000))
    began = time.monotonic()
    got = {r.doc_id: r for r in lines.dedup(make([(1, many), (2, many + "\nend")]), counts=True).collect()}
    assert got[1].text == many and got[2].text == "end" and got[2].n_removed == 150_000 and time.monotonic() - began < 60


# --- substrings


def repeated(rows, length, keep):
    """Byte by byte, with all strings in a dictionary."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    first, count = {}, {}
    for k, (_, t) in enumerate(order):
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            first.setdefault(s, (k, p))
            count[s] = count.get(s, 0) + 1
    out = []
    for k, (i, t) in enumerate(order):
        b = (t or "").encode()
        cut = bytearray(len(b))
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            if count[s] > 1 and (keep == "none" or first[s] != (k, p)):
                cut[p : p + length] = b"\1" * length
        kept = bytes(x for x, c in zip(b, cut) if not c)
        n = sum(c and not (q and cut[q - 1]) for q, c in enumerate(cut))
        out.append((str(i), len(b), sum(cut), n, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def string_rows(rng):
    a, b = words(rng, 30), words(rng, 25)
    rows = [(1, a), (2, "x" + a[3:90] + "y"), (3, a[:60] + b + a[20:100]), (4, b + b), (5, "é" * 60), (6, "ab" * 70), (7, ""), (8, None), (9, "short"), (10, b[:39]), (11, b[:40]), (12, words(rng, 3000)), (13, a), (14, words(rng, 20) + b[5:80] + words(rng, 20)), (None, b[10:70])]
    return rows + [(40 + k, words(rng, 5) + " " + b[:70] + " " + words(rng, 5)) for k in range(12)]


@settings(max_examples=150, deadline=None)
@given(st.binary(min_size=12, max_size=120).map(lambda b: bytes(x & 1 for x in b)), st.sampled_from([8, 11, 12]))
def test_smaller_positions_and_previous_factors(data, length):
    raw = np.frombuffer(data, np.uint8)
    n = len(data) - length + 1
    sa, lcp = substrings.suffix_array(raw, np.arange(n), length)
    win = [data[p : p + length] for p in range(n)]
    common = lambda x, y: next((k for k in range(length) if x[k] != y[k]), length)
    assert sa.tolist() == sorted(range(n), key=lambda p: (win[p], p))
    assert lcp.tolist() == [0, *(common(win[a], win[b]) for a, b in zip(sa[:-1], sa[1:]))]
    before, after, factor, source = substrings.previous_factors(sa, lcp)
    for r, p in enumerate(sa.tolist()):
        assert before[p] == next((q for q in sa[:r][::-1].tolist() if q < p), -1) and after[p] == next((q for q in sa[r + 1 :].tolist() if q < p), -1)
        assert factor[p] == max((common(win[p], win[q]) for q in range(p)), default=0) and (not factor[p] or (source[p] < p and common(win[p], win[source[p]]) == factor[p]))


@pytest.mark.parametrize("keep, length, gram, windows", [("none", 40, 12, 10**6), ("none", 40, 12, 2), ("first", 40, 12, 10**6), ("first", 40, 12, 2), ("none", 44, 13, 10**6), ("none", 200, 40, 10**6), ("none", 200, 40, 2)])
def test_substrings_match_brute_force(make, rng, keep, length, gram, windows):
    rows = string_rows(rng)
    if length == 200:
        rows = [(i, t and "".join(w + w[::-1] + w for w in t.split(" "))) for i, t in rows]
    got = substrings.dedup(make(rows), length=length, gram=gram, keep=keep, max_windows=windows).collect()
    assert sum(r.n_removed for r in got) and sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == repeated(rows, length, keep)
    for r in got:
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and sum(s.end - s.start for s in r.spans) == r.n_removed


def test_substrings_odd_tables(make, rng):
    assert substrings.dedup(make([(1, "a")]).where("false")).count() == 0
    same = words(rng, 60)
    first = substrings.dedup(make([(3, same), (None, same), (4, same)]), keep="first").collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in first) == [("3", len(same)), ("4", len(same)), ("None", 0)]
    got = substrings.dedup(make([(1, same), (1, same), (2, None)])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, len(same)), (1, len(same)), (2, 0)]
