"""HTML extraction, chat formatting, packing and media containers: expected texts and exact round trips."""

import hashlib
import json
import os
import re
import struct
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from specloom.llm import chat, html, media, packing

from .conftest import words

# --- html

NAV = '<nav><ul><li><a href="/a">Home</a></li></ul></nav>'


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("<p>One<p>Two&nbsp;&amp; <b>th</b>ree<br>four", "One Two & three four"),
        (f"<html><head><title>T</title><style>p{{}}</style></head><body>{NAV}<article><h1>H  h</h1><p><b>a.<br><p>b</p>\n c</article><footer>F</footer>", "H h a. b c"),
        ("<body><header>Site</header><main><header><h1>Head</h1></header><p>Text</p><form>f <input></form><aside>s</aside></main></body>", "Head Text"),
        ("<article><p>Body body</p><section id=comments><p>first!</p></section><div class='post-comments'>me too</div><div class=\"ad\">buy</div></article>", "Body body"),
        ("<article>Real text here<article class='comment'>no</article></article>", "Real text here"),
        ("<article><p>x</p><script>var a='<p>no</p>';</script><noscript>no</noscript><div style='display: none'>no</div><p hidden>no</p><div role=alert>no</div></article>", "x"),
        ("<div class=menu>menu menu</div><div id=page><div><p>A long paragraph of the text.</p><p>Another long one.</p></div></div><div>short</div>", "A long paragraph of the text. Another long one."),
        ("<body><div>All <a href=/>menus</a> <a href=/>and links here</a></div><div><div><p>A long paragraph of the text.</p></div><div><p>Another of them.</p></div></div><div>short</div></body>", "A long paragraph of the text. Another of them."),
        ("<article><p>Text <span class=ad>buy now</span> goes on</p><p class='notice'>no</p><p class='share-count-ok'>yes</p><button>b</button></article>", "Text goes on yes"),
        ("<html><head><meta charset=x><title>T</title><body><article>A</article>", "A"),
        ("<title>T</title><link rel=x><div><p>No head, no body.</p></div>", "No head, no body."),
        ("<article>a &lt;b&gt; &#233; &#x41; &copy; &amp</article>", "a <b> é A © &"),
        ("<article><!-- no <p> --><p>in<em>line</em>d</p> <ul><li>one<li>two</ul></article>", "inlined one two"),
        ("<ARTICLE><P>Upper</P></ARTICLE><article>x</article>", "Upper"),
        ("<article><p>broken <a href='x>y'>link</a> end", "broken link end"),
    ],
)
def test_main_text(page, text):
    assert html.extract(page) == text


def flat(nodes):
    for n in nodes:
        yield n
        yield from flat(n.group)


def test_wrappers_find_groups_and_slots(spark):
    page = lambda k, n, extra="": f"<html><body><div class=top>Daily News</div><div class=body><h1>Title {k}</h1>{''.join(f'<p>Paragraph {k} {j} of the text</p>' for j in range(n))}</div>{extra}<div class=low>All rights kept</div></body></html>"
    pages = [page(1, 2), page(2, 4), page(3, 1, "<div class=box>Extra</div>"), page(4, 3)]
    wrapper = html.infer([html.parse(p).stream for p in pages])
    assert any(n.repeated and n.group for n in flat(wrapper)) and any(n.optional for n in flat(wrapper))
    assert {t for _, t in html.slots(wrapper, 4)[0]} == {"Daily News", "All rights kept"}
    rows = [(k, "http://Site.example/x" if k < 5 else None, p, "clash") for k, p in enumerate([*pages, None, "", page(9, 2)])] + [(0, "http://site.example/y", pages[0], "clash")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {(r.page_id, r.url): r for r in html.extract_pages(df).collect()}
    assert len(got) == 8 and got[1, "http://Site.example/x"].text == "Title 2 " + " ".join(f"Paragraph 2 {j} of the text" for j in range(4))
    assert got[4, "http://Site.example/x"].text == got[5, None].text == "" and all(r.n_chars == len(r.text) for r in got.values())
    assert html.extract_pages(df.where("false")).count() == 0


def regex(nodes):
    """The wrapper as a plain regular expression over one letter for each shape."""
    letters = {}

    def one(n):
        body = "".join(map(one, n.group)) if n.group else re.escape(letters.setdefault(n.shape, chr(0x4E00 + len(letters))))
        return f"(?:{body}){'*' if n.optional and n.repeated else '+' if n.repeated else '?' if n.optional else ''}"

    return "".join(map(one, nodes)), letters


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<p>x</p>", "<ul><li>a</li></ul>", "<ul><li>a</li><li>b</li></ul>", "<div class=k><p>y</p></div>", "<h1>t</h1>", "<br>", "z", "<table><tr><td>1</td><td>2</td></tr></table>"]), max_size=8), min_size=1, max_size=5))
def test_a_wrapper_matches_all_its_pages(pages):
    streams = [html.parse("<body>" + "".join(p) + "</body>").stream for p in pages]
    wrapper = html.infer(streams)
    pattern, letters = regex(wrapper)
    for s in streams:
        assert re.fullmatch(pattern, "".join(letters[t[0]] for t in s))
    # each slot knows the texts of the pages: none is noted that a page does not have, none is lost
    noted = {(t, k) for n in flat(wrapper) if not n.group for t, on in n.texts.items() for k in on}
    assert noted == {(t[3], k) for k, s in enumerate(streams) for t in s if t[0] == "#"}


def site(k, body, side=""):
    return f"<html><body><div class=sitewide><p>The same house notice on every page of it</p></div><div class='layout sidebar'><div class=story><h1>Title {k}</h1>{body}<p>Written by the house staff</p></div></div><div class=more><p>Next {side}</p></div></body></html>"


def test_the_wrapper_decides(spark):
    body = lambda k: "".join(f"<p>Paragraph {k} {j} tells what happened there</p>" for j in range(3))
    want = lambda k: f"Title {k} " + " ".join(f"Paragraph {k} {j} tells what happened there" for j in range(3))
    pages = [site(k, body(k), f"teaser {k}") for k in range(6)]
    wrapper = html.learn([html.parse(p) for p in pages])
    for k, p in enumerate(pages):
        assert html.extract(p, wrapper) == want(k)  # fixed slots go inside the main element too, and its own name does not switch it off
        assert html.extract(p) != want(k)
    articles = [f"<body><article><p>Sign in to read all of our stories</p>{body(k)}</article><article><p>Other {k}</p></article></body>" for k in range(5)]
    wrapper = html.learn([html.parse(p) for p in articles])
    assert [html.extract(p, wrapper) for p in articles] == [want(k).removeprefix(f"Title {k} ") for k in range(5)]
    assert "Sign in" in html.extract(articles[0])
    long = [site(k, "".join(f"<p>Line {k} {j} of a very long page</p>" for j in range(4000)), f"teaser {k}") for k in range(4)]  # pages above 64 KB have wrappers too
    rows = [(k, "http://long.example/", p) for k, p in enumerate(long)]
    got = {r.page_id: r.text for r in html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"Title {k} " + " ".join(f"Line {k} {j} of a very long page" for j in range(4000)) for k in range(4))


def test_deep_pages_take_time_in_proportion():
    began = time.monotonic()
    assert html.extract("<div>x" * 100_000) == " ".join("x" * 100_000)
    assert html.extract("<article>" + "<p><b><i>y" * 50_000).count("y") == 50_000
    assert time.monotonic() - began < 15


@pytest.mark.parametrize(
    "page, text",
    [
        ("<body><div class='layout has-sidebar'><article><p>The text</p></article></div>", "The text"),
        ("<body><div class='no-comments'><section id=content-with-sidebar><h1>Beside</h1><main><p>The text</p><div class=ad>buy</div></main></section><div class=ad>buy</div></div>", "The text"),
        ("<body><div class=related><article>Teaser that is longer than all</article></div><article>Text</article>", "Text"),
        ("<body><div class=has-sidebar><article class=comment>A long reader comment</article><article>Text</article></div>", "Text"),
    ],
)
def test_names_around_the_main_element(page, text):
    assert html.extract(page) == text


def test_copies_and_repeats_are_no_template(spark):
    copy = "<body><p>The same whole article on two pages.</p><p>And its end.</p></body>"
    rows = [(k, "http://two.example/", copy) for k in range(2)] + [(k, "http://many.example/", copy if k < 32 else f"<body><p>Another article {k}.</p></body>") for k in range(2, 40)]
    got = html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.text == "The same whole article on two pages. And its end." for r in got if r.page_id < 32)
    # a cell that repeats inside one page is no template of its host
    tables = [f"<body><p>Long text of page number {k} as it goes {k}.</p><ul>{'<li>yes</li>' * (6 if k == 0 else 0)}<li>item {k}</li></ul><div>Foot</div></body>" for k in range(4)]
    assert {t for _, t in html.learn([html.parse(p) for p in tables]).fixed} == {"Foot"}


def test_very_long_page_is_whole():
    page = "<article>" + "".join(f"<p>{k} word</p>" for k in range(30_000)) + "</article>"
    assert html.extract(page) == " ".join(f"{k} word" for k in range(30_000))


# --- chat


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<|\\>im_endstar\nx", max_size=40), st.text(alphabet="us<|\\n\n>", max_size=12))
def test_turns_round_trip(text, role):
    turn, a, b, _ = chat.turn_text(role, [{"type": "text", "text": text}])
    assert chat.read_turn(turn) == (role, text)
    assert turn.count("<|") == 2 and chat.unescape(turn[a:b]) == text


def test_typed_parts():
    parts = [{"type": "text", "text": "see <|image|>"}, {"type": "image", "ref": "i.png", "width": 56, "height": 30}, {"type": "audio", "ref": "a.wav", "seconds": 1.5}, {"type": "document", "ref": "d.pdf", "pages": 2}, {"type": "text", "text": "end"}]
    turn, a, b, attached = chat.turn_text("user", parts)
    assert turn[a:b] == "see <\\|image|><|image|><|audio|><|document|>end"
    assert attached == [{"kind": "image", "ref": "i.png", "tokens": 4}, {"kind": "audio", "ref": "a.wav", "tokens": 38}, {"kind": "document", "ref": "d.pdf", "tokens": 512}]
    with pytest.raises(ValueError):
        chat.turn_text("user", [{"type": "smell"}])


def test_conversations(spark):
    said = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 1, "assistant", "b<\\|"), (1, 0, "user", "a"), (1, 2, None, None), (2, 0, "assistant", said), (2, 0, "assistant", said), (None, 0, "user", "x"), (3, 0, "assistant", "é" * 50_000), (3, 1, "assistant", "two")]
    rows += [(4, k, "user" if k % 2 else "assistant", f"t{k}") for k in range(3000)]
    df = spark.createDataFrame([(*r, "clash", k) for k, r in enumerate(rows)], "conv_id long, turn long, role string, text string, formatted string, n long")
    turns = chat.format_turns(df)
    got = {r.conv_id: r for r in chat.digest(turns).collect()}
    assert len(got) == 5
    for c, r in got.items():
        own = sorted(((t, ro or "", x or "") for k, t, ro, x in rows if k == c))
        loss = "".join(x for _, ro, x in own if ro == "assistant")
        assert r.n_turns == len(own) and r.turns_sha256 == hashlib.sha256("".join(f"{ro}\n{x}\n" for _, ro, x in own).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == sum(len(chat.turn_text(ro, [{"type": "text", "text": x}])[0]) for _, ro, x in own)
    assert chat.digest(chat.format_turns(df.where("false"))).count() == 0
    withparts = df.where("conv_id = 1").selectExpr("*", """'[{"type": "image", "ref": "r"}]' AS parts""")
    r = chat.format_turns(withparts, parts_col="parts").first()
    assert r.expanded_tokens == 1 and r.attachments[0].ref == "r"


# --- packing


@pytest.fixture(scope="module")
def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.json")


def check_pieces(rows, ids, top=1024):
    """Each id lies in one piece, sequences are gapless, and sizes are powers of two."""
    docs, seqs = {}, {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append(r)
        docs.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for parts in seqs.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= top and at & (at - 1) == 0 and at <= parts[0].tier
    for (d, n), parts in docs.items():
        copies = sum(len(x) == n for x in ids[d])
        covered = sorted((r.start, r.length) for r in parts)
        total = [0] * n
        for s, k in covered:
            for j in range(s, s + k):
                total[j] += 1
        assert set(total) == {copies}
        for r in parts:
            assert r.ids_crc32 in {zlib.crc32(x[r.start : r.start + r.length].astype("<u4").tobytes()) for x in ids[d] if len(x) == n}


def test_packing(make, rng, tokenizer):
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(tokenizer)
    rows = [(k, words(rng, rng.choice([1, 5, 40, 300, 900]))) for k in range(60)] + [(100, None), (101, ""), (102, "a <|endoftext|> b"), (103, "漢字 кириллица 🙂"), (104, words(rng, 9000)), (5, "again"), (None, "no id"), (105, "x" * 5000), (106, " \n\t ")]
    got = packing.pack(make(rows), tokenizer, pool_tokens=4096).collect()
    ids = {}
    for d, t in rows:
        ids.setdefault(d, []).append(np.array([*full.encode(t or "", add_special_tokens=False).ids, 0]))
    check_pieces(got, ids)
    groups = {}
    for r in got:
        groups[r.step_group] = groups.get(r.step_group, 0) + r.length
    short = [g >> 33 for g, n in groups.items() if n != 16 * 1024]
    assert max(groups.values()) == 16 * 1024 and len(short) == len(set(short))  # the last of each partition
    assert packing.pack(make(rows).where("false"), tokenizer).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 3000), max_size=60), st.integers(0, 2000))
def test_packer_wastes_nothing(sizes, pool):
    p = packing.Packer(0, packing.TIERS, 16 * 1024)
    for d, n in enumerate(sizes):
        p.add(d, np.arange(n, dtype="<u4"))
        if p.waiting > pool:
            p.pack(False)
    p.pack(True)

    class Row:
        def __init__(self, r):
            self.doc_id, self.start, self.length, self.ids_crc32, self.doc_tokens, self.sequence_id, self.offset, self.tier, self.step_group = r

    check_pieces([Row(r) for r in p.rows], {d: [np.arange(n)] for d, n in enumerate(sizes)})
    assert sum(r[2] for r in p.rows) == sum(sizes)


def test_quick_encoder_agrees_with_the_tokenizer(tokenizer):
    from tokenizers import Tokenizer

    full, encode = Tokenizer.from_file(tokenizer), packing.encoder(tokenizer)
    for t in ("", "It's  a\n\n test… 12345 'll", "ÄÖÜ ß ñ ç  x", "퟿\U0001f600 ɐ", "\t \r\n  x  ", "a" * 3000, "é" * 300, "a" + " " * 3_000_000 + "b", "x <|endoftext|> y"):
        assert list(encode(t)) == full.encode(t, add_special_tokens=False).ids
    # every letter, in the places where the pattern treats kinds of letters differently
    letters = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(letters), 2048):
        t = "".join(f"a{c}b 1{c}2 .{c}; {c}{c} {c}'s\n" for c in letters[k : k + 2048])
        assert list(encode(t)) == full.encode(t, add_special_tokens=False).ids
    for sf in ("0.001", "0.01"):
        if os.path.exists(f"/root/testdata/sf{sf}/documents.parquet"):
            import pyarrow.parquet as pq

            for t in pq.read_table(f"/root/testdata/sf{sf}/documents.parquet")["text"].to_pylist():
                assert list(encode(t or "")) == full.encode(t or "", add_special_tokens=False).ids


# --- media


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 3000), st.integers(1, 40), st.integers(1, 2000))
def test_media_round_trip(units, every, per_chunk):
    payload = np.random.default_rng(units).bytes(units * 64)
    data = media.mux(payload, key_every=every, per_chunk=per_chunk)
    f = media.features(data)
    assert (f["status"], f["codec"], f["timescale"], f["duration"], f["n_samples"]) == ("ok", "raw ", 8000, len(payload), units)
    assert media.read_samples(data, f["ranges"]) == payload
    assert [data[s : s + n] for s, n in f["keyframes"]] == [payload[k * 64 : k * 64 + 64] for k in range(0, units, every)]


def test_odd_boxes():
    data = media.mux(bytes(range(64)) * 3)
    assert media.features(data + media._box(b"free", b"xx"))["n_samples"] == 3
    wide = data.replace(struct.pack(">I4s", 8 + 192, b"mdat"), struct.pack(">I4s", 0, b"mdat"))  # to the end of the file
    assert media.features(wide)["n_samples"] == 3
    for cut in (1, 7, 40, 200, 400, len(data) - 1):
        assert media.features(data[:cut])["status"].startswith("bad")
    assert media.features(b"")["status"] == media.features(None)["status"] == "empty"
    broken = bytearray(data)
    at = data.index(b"stsz")
    broken[at + 12 : at + 16] = b"\xff\xff\xff\xff"
    assert media.features(bytes(broken))["status"].startswith("bad")


def test_deep_boxes_and_fragments():
    data = media.mux(bytes(range(64)) * 3)
    deep = b""
    for _ in range(3000):
        deep = media._box(b"moov", deep)
    assert media.features(deep)["status"] == "bad: no track" and media.features(data + deep)["n_samples"] == 3
    u = lambda *x: struct.pack(f">{len(x)}I", *x)
    track = lambda k: media._box(b"trak", media._box(b"tkhd", u(7, 0, 0, k)), media._box(b"mdia", media._box(b"mdhd", u(0, 0, 0, 1000, 0, 0)), media._box(b"hdlr", u(0, 0), b"vide" if k == 1 else b"soun", bytes(13)), media._box(b"minf", media._box(b"stbl", media._box(b"stsd", u(0, 1), media._box(b"avc1" if k == 1 else b"mp4a", bytes(20))), media._box(b"stsz", u(0, 0, 0))))))
    moov = media._box(b"moov", track(1), track(2), media._box(b"mvex", media._box(b"trex", u(0, 1, 1, 40, 9, 0x10000)), media._box(b"trex", u(0, 2, 1, 20, 5, 0))))

    def moof(shift):
        video = media._box(b"traf", media._box(b"tfhd", u(0x20000, 1)), media._box(b"trun", u(0x205, 3), struct.pack(">iI", shift, 0), u(4, 2, 3)))
        sound = media._box(b"traf", media._box(b"tfhd", u(0x20000 | 0x8, 2, 30)), media._box(b"trun", u(0x1, 2), struct.pack(">i", shift + 9)), media._box(b"trun", u(0, 1)))
        return media._box(b"moof", video, sound)

    body = b"VVVVvvvvvSSSSSTTTTTUUUUU"
    one = moof(0)
    part = moof(len(one) + 8) + media._box(b"mdat", body)
    f = media.features(media._FTYP + moov + part + part)
    at = len(media._FTYP) + len(moov) + len(one) + 8
    assert f["status"] == "ok" and [(t["codec"], t["handler"], t["n_samples"], t["duration"]) for t in f["tracks"]] == [("avc1", "vide", 6, 240), ("mp4a", "soun", 6, 180)]
    assert f["keyframes"].tolist() == [[at, 4], [at + len(part), 4]] and media.read_samples(media._FTYP + moov + part + part, f["tracks"][1]["ranges"]) == body[9:] * 2
    for cut in range(1, len(part), 7):  # a broken fragment is an error of its file, never a crash
        assert media.features(media._FTYP + moov + part[:-cut])["status"].split(":")[0] in ("bad", "ok")


def test_media_columns(spark, make):
    rows = [(1, None), (2, ""), (3, "é"), (4, "x" * 64), (5, "y" * 100_000), (6, "x" * 64), (None, "z")]
    got = {r.doc_id: r for r in media.store_texts(make(rows)).collect()}
    for d, t in rows:
        b = (t or "").encode()
        p = b + bytes(64 - len(b) % 64 if len(b) % 64 or not b else 0)
        r = got[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert r.media_sha256 == hashlib.sha256(media.mux(p)).hexdigest() and json.loads(r.feature)["samples"] == len(p) // 64
    assert got[4].feature == got[6].feature and got[1].media_sha256 == got[2].media_sha256
    files = spark.createDataFrame([(1, media.mux(bytes(64 * 40)), 5), (2, None, 6), (3, b"junk", 7)], "k long, media binary, id int")
    d = {r.k: r for r in media.describe(files, "k", "media").collect()}
    assert d[1].status == "ok" and len(d[1].keyframes) == 3 and d[2].status == "empty" and d[3].status.startswith("bad")
    assert media.store_texts(make(rows).where("false")).count() == 0
