"""HTML extraction by inferred wrappers.

Pages of one host come from templates. From a sample of a host's pages a wrapper is inferred, a union-free regular expression
over tokens: the wrapper starts as the first page's tokens and is aligned with each further page. Where they agree it stays; a differing text becomes
a slot; a differing run of tags becomes a repeated group if it continues what its sibling just before it holds, else an optional group.

The wrapper decides what is main text on its host, inside article elements too:

* a slot whose text is the same on nearly all sampled pages that differ (three at least) is template, and such texts are dropped wherever they stand at that path;
* what varies in the remaining slots shows the host's main element: the innermost one around three quarters of the varying prose. A page's text is what lies there, and what stands
  directly in the elements around it; if the same path occurs as several article elements, the largest;
* a repeated group of links is a list of teasers, not prose.

Tags, roles, and class and id words of parts that are never main text (menus, headers and footers of the page, sidebars, notices, adverts, forms, scripts, styles, reader comments) support
this: they drop what lies in such elements, but words do not switch off elements around the main element. A page without its host's main element, or of a host with fewer than three different
pages, is read by its own largest article or main element, else by the innermost element that holds three quarters of its prose.

Character references are decoded; white space inside a block becomes one space; blocks are trimmed and joined in page order by one space. Nothing else is dropped or cut.

Wrappers are inferred from at most ``SAMPLE`` whole pages a host, taken in the order of a hash of the page; every page is extracted
from its whole html, in time that follows its length. Null and empty pages have the empty text. Null urls form a host of their own; null ids pass through. Repeated pages give repeated rows; an
empty table gives none; other columns are not read.
"""

from __future__ import annotations

import html as _html
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _runtime

SAMPLE = 8
#: Different pages that must hold a text before it is template.
LEAST = 3
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript"}
#: Elements that never hold main text.
DROP_TAGS = {"script", "style", "noscript", "template", "head", "title", "nav", "footer", "aside", "form", "button", "select", "textarea", "option", "iframe", "object", "svg", "canvas", "dialog", "menu", "input", "label", "noembed", "noframes", "audio", "video", "map", "fieldset", "datalist"}
DROP_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar", "status", "note", "tablist"}
#: Words of class and id names of parts that are not main text.
DROP_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "cookie", "cookies", "consent", "disqus", "discussion", "footer", "foot", "gdpr", "header", "masthead", "menu",
    "menus", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "notifications", "overlay", "pager", "pagination", "popup", "promo", "promoted", "promotion", "related", "replies", "reply", "respond", "recommended", "share", "sharing", "sidebar", "sidenav",
    "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "subscription", "tags", "toolbar", "topbar", "widget", "widgets", "alert", "toc", "legal", "copyright", "rail", "aside", "teaser", "paywall", "login", "search", "hidden",
}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
#: Elements that can hold a whole article.
CONTAINERS = {"body", "center", "div", "section", "td"}
#: A start tag closes an open element of these, as HTML allows their end tags to be left out.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
HEAD = {"base", "head", "link", "meta", "noscript", "script", "style", "template", "title"}
LIMITS = {"ul", "ol", "dl", "table", "select", "div", "article", "section", "body"}
P_ENDS = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "ul"}
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<![^>]*(?:>|$)|<\?[^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>\x00]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|$)", re.S)
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?", re.S)
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[a-z]+")


@dataclass
class Token:
    kind: str  # "<", ">" or "text"
    name: str  # tag, or the text
    attrs: dict = field(default_factory=dict)

    @property
    def shape(self) -> str:
        """What alignment compares: tags with their class, all texts alike."""
        return "#" if self.kind == "text" else f"{self.kind}{self.name}.{self.attrs.get('class', '')}"


def tokenize(page: str) -> Iterator[Token]:
    """Tags and texts in order; comments and declarations are left out. Raw elements give their content as one text."""
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            yield Token("text", page[at:])
            return
        if m.start() > at:
            yield Token("text", page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            yield Token(">", name)
            continue
        attrs = {a[1].lower(): _html.unescape(a[2] or a[3] or a[4] or "") for a in _ATTR.finditer(m[3])} if m[3].strip(" /") else {}
        yield Token("<", name, attrs)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|$)", re.I).search(page, at)
            stop = end.start() if end else n
            if stop > at:
                yield Token("text", page[at:stop])
            at = stop


def dropped(t: Token) -> bool:
    """Whether an element is of a kind that is never main text, by tag, role or style. The heading of an article may stand in a header element."""
    a = t.attrs
    if t.name in DROP_TAGS or a.get("role", "").lower() in DROP_ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true":
        return True
    return "display:none" in a.get("style", "").lower().replace(" ", "")


def named(t: Token) -> bool:
    """Whether an element's class or id names a part that is not main text."""
    a = t.attrs
    if t.name in ("html", "body", "main"):
        return False
    if t.name in ("article", "p", "h1", "h2", "h3"):  # their classes often name features; only a whole word counts
        return any(w in DROP_WORDS for w in a.get("class", "").lower().split())
    return any(w in DROP_WORDS for v in (a.get("class", ""), a.get("id", "")) for w in _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", v).lower()))


@dataclass
class Block:
    path: int  # hash of the shapes of open elements
    text: str
    main: int  # number of the main element around it, -1 if none
    off: bool
    linked: int  # characters inside links
    inside: int  # number of the innermost open container, -1 if none
    names: int  # number of the innermost open element whose name says that it is not main text, 0 if none
    under: int  # names of the host's main element around it, -1 outside


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    stream: list[tuple] = field(default_factory=list)  # (shape, depth, path, text, linked) of each token, for alignment
    containers: list[tuple[int, int]] = field(default_factory=list)  # (number of the one around it, path)
    names: list[int] = field(default_factory=lambda: [-1])  # of each element off by name, the one around it
    main_names: list[int] = field(default_factory=list)  # names around each main element


@dataclass
class Open:
    name: str
    path: int
    off: bool
    container: int
    names: int
    main: int
    under: int


def _path(around: int, shape: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{around} {shape}") >> 1


def parse(page: str, main_path: int = -1) -> Page:
    """A page's blocks and tokens. Elements lie on a stack with counters by name, so a token's cost does not follow the depth."""
    out = Page()
    root = Open("", 0, False, -1, 0, -1, -1)
    stack = [root]
    places: dict[str, list[int]] = defaultdict(list)  # where the stack holds elements of a name
    limits = [0]
    n_main, linked = -1, 0
    piece: list[str] = []

    def close_block() -> None:
        nonlocal piece, linked
        if piece:
            text, top = _SPACE.sub(" ", "".join(piece)).strip(), stack[-1]
            if text:
                out.blocks.append(Block(top.path, text, top.main, top.off, linked, top.container, top.names, top.under))
            piece, linked = [], 0

    def pop_to(size: int) -> None:
        while len(stack) > size:
            places[stack.pop().name].pop()
        while limits[-1] >= size:
            limits.pop()

    for t in tokenize(page):
        top = stack[-1]
        if t.kind == "text":
            text = t.name if top.name in ("script", "style") else _html.unescape(t.name)
            if text.strip():
                out.stream.append(("#", len(stack), top.path, _SPACE.sub(" ", text).strip(), bool(places["a"])))
            if not top.off:  # an advert may stand inside a block, as in a span
                piece.append(text)
                if places["a"]:
                    linked += len(text.strip())
            continue
        block = t.name in BLOCKS or t.name in DROP_TAGS
        if block:
            close_block()
        if t.kind == ">":
            if places[t.name]:
                pop_to(places[t.name][-1])
            elif t.name == "p":
                continue
            out.stream.append((t.shape, len(stack), 0, "", False))
            continue
        if places["head"] and t.name not in HEAD:  # its end tag may be left out
            pop_to(places["head"][0])
        if t.name in P_ENDS and places["p"] and limits[-1] < places["p"][-1]:
            pop_to(places["p"][-1])
        last = max((places[n][-1] for n in CLOSES.get(t.name, ()) if places[n]), default=0)
        if last > limits[-1]:
            pop_to(last)
        out.stream.append((t.shape, len(stack), 0, "", False))
        if t.name in VOID:
            continue
        top = stack[-1]
        within = top.main >= 0
        by_name = named(t)
        new = Open(t.name, _path(top.path, t.shape) if block else top.path, top.off, top.container, top.names, top.main, top.under)
        new.off = top.off or dropped(t) or (t.name == "header" and not within) or (by_name and (within or not block or t.name == "article"))
        if by_name and not new.off:
            new.names = len(out.names)
            out.names.append(top.names)
        if t.name in CONTAINERS or t.name in ("article", "main"):
            new.container = len(out.containers)
            out.containers.append((top.container, new.path))
        if t.name in ("article", "main") and not within:
            n_main += 1
            new.main = n_main
            out.main_names.append(new.names)
        if block and new.path == main_path and top.under < 0:
            new.under = new.names
        if t.name in LIMITS:
            limits.append(len(stack))
        places[t.name].append(len(stack))
        stack.append(new)
    close_block()
    return out


@dataclass
class Node:
    """A part of a wrapper: a tag or text slot, or a group of parts that may be absent or repeat."""

    shape: str
    depth: int
    path: int = 0
    texts: dict = field(default_factory=dict)  # text -> numbers of the pages that had it
    optional: bool = False
    repeated: bool = False
    linked: bool = True  # all texts inside links
    group: list = field(default_factory=list)


def _node(token: tuple, page: int) -> Node:
    return Node(token[0], token[1], token[2], {token[3]: {page}}, linked=token[4]) if token[0] == "#" else Node(token[0], token[1])


def _fits(node: Node, stream: list[tuple], at: int, page: int = -1) -> int:
    """Where the stream goes on after node, with all its repeats; -1 if it does not begin with it. Given a page number, the texts of its slots are noted."""

    def once(at: int) -> int:
        if not node.group:
            if at >= len(stream) or stream[at][0] != node.shape:
                return -1
            if page >= 0 and node.shape == "#":
                node.texts.setdefault(stream[at][3], set()).add(page)
                node.linked &= stream[at][4]
            return at + 1
        for part in node.group:
            end = _fits(part, stream, at, page)
            if end < 0 and not part.optional:
                return -1
            at = max(at, end)
        return at

    end = once(at)
    if end <= at:
        return -1
    while node.repeated and (page < 0 or _fits(node, stream, end) > 0) and (more := once(end)) > end:
        end = more
    return end


def _resume(wrapper: list[Node], i: int, stream: list[tuple], j: int) -> tuple[int, int]:
    """The nearest place where both go on: the pair of equal tags with the fewest tokens skipped in all. Looks no further than it skips."""
    mine: dict[str, int] = {}
    its: dict[str, int] = {}
    best, d = None, 0
    while (best is None or d < best[0]) and (i + d < len(wrapper) or j + d < len(stream)):
        if i + d < len(wrapper) and (shape := wrapper[i + d].shape) != "#":
            mine.setdefault(shape, d)
            if shape in its and (best is None or d + its[shape] < best[0]):
                best = d + its[shape], i + d, j + its[shape]
        if j + d < len(stream) and (shape := stream[j + d][0]) != "#":
            its.setdefault(shape, d)
            if shape in mine and (best is None or d + mine[shape] < best[0]):
                best = d + mine[shape], i + mine[shape], j + d
        d += 1
    return best[1:] if best else (len(wrapper), len(stream))


def _sibling(out: list[Node], token: tuple) -> int:
    """Where in ``out`` the element of the same shape and parent begins that lies nearest before the token, -1 without any."""
    for k in range(len(out) - 1, -1, -1):
        if out[k].depth < token[1]:
            return -1
        if out[k].depth == token[1] and out[k].shape == token[0]:
            return k
    return -1


def align(wrapper: list[Node], stream: list[tuple], page: int) -> list[Node]:
    """The wrapper generalised to also match the page.

    At a mismatch both go on at the nearest equal tags. Of the tokens skipped, those of the wrapper become optional; those of the page become a repeated group with the sibling
    before them if they repeat it (a square), else optional.
    """
    out: list[Node] = []
    i = j = 0
    while i < len(wrapper) or j < len(stream):
        if i < len(wrapper):
            end = _fits(wrapper[i], stream, j)
            if end >= 0:
                j = _fits(wrapper[i], stream, j, page)
                out.append(wrapper[i])
                i += 1
                continue
            if wrapper[i].optional:
                out.append(wrapper[i])
                i += 1
                continue
        to_i, to_j = _resume(wrapper, i, stream, j)
        if (to_i, to_j) == (i, j):  # the first token of a group fits but not the whole group
            to_i = i + 1
        for node in wrapper[i:to_i]:
            node.optional = True
            out.append(node)
        while j < to_j:
            k = _sibling(out, stream[j]) if stream[j][0][0] == "<" else -1
            end = j
            for part in out[k:] if k >= 0 else []:
                end = _fits(part, stream, end)
                if end < 0:
                    break
            if end > to_j or end <= j:
                node = _node(stream[j], page)
                node.optional = True
                out.append(node)
                j += 1
                continue
            if len(out) - k > 1 or not out[k].group:
                out[k:] = [Node(out[k].shape, out[k].depth, group=out[k:], optional=all(t.optional for t in out[k:]))]
            out[k].repeated = True
            j = _fits(out[k], stream, j, page)
        i = to_i
    return out


def infer(pages: list[list[tuple]]) -> list[Node]:
    wrapper = [_node(t, 0) for t in pages[0]] if pages else []
    for k, p in enumerate(pages[1:], 1):
        wrapper = align(wrapper, p, k)
    return wrapper


def different(pages: list[Page]) -> list[Page]:
    """Pages without those that share half of their characters, by distinct texts, with an earlier one: copies say nothing about a template."""
    kept: list[tuple[set, Page]] = []
    size = lambda texts: sum(map(len, texts))
    for p in pages:
        own = {t[3] for t in p.stream if t[0] == "#"}
        if own and all(2 * size(own & other) < size(own | other) for other, _ in kept):
            kept.append((own, p))
    return [p for _, p in kept]


@dataclass
class Wrapper:
    """What a host's wrapper says of its pages."""

    fixed: frozenset = frozenset()  # (path, text) of template texts
    lists: frozenset = frozenset()  # paths of repeated groups of links
    main: int = -1  # path of the main element, -1 if none stands out
    around: frozenset = frozenset()  # paths of the containers around it

    def dump(self) -> str:
        return json.dumps([sorted(self.fixed), sorted(self.lists), self.main, sorted(self.around)])

    @classmethod
    def load(cls, text: str) -> Wrapper:
        fixed, lists, main, around = json.loads(text)
        return cls(frozenset(map(tuple, fixed)), frozenset(lists), main, frozenset(around))


def slots(wrapper: list[Node], n_pages: int, share: float = 0.8) -> tuple[frozenset, frozenset]:
    """(path, text) of slots whose text is the same on ``share`` of the pages or more, and on ``LEAST`` at least; paths of slots in repeated groups that are links throughout."""
    fixed, lists, plain = set(), set(), set()
    todo = [(x, False) for x in wrapper]
    while todo:
        x, again = todo.pop()
        todo += [(y, again or x.repeated) for y in x.group]
        if x.shape == "#" and not x.group:
            fixed.update((x.path, t) for t, on in x.texts.items() if len(on) >= max(LEAST, share * n_pages))
            (lists if again and x.linked else plain).add(x.path)
    return frozenset(fixed), frozenset(lists - plain)


def _weigh(pages: list[list[tuple[int, int]]], prose: list[list[Block]]) -> tuple[int, frozenset]:
    """The innermost container around three quarters of the prose, and those around it. Of each page: (number of the container around it, name by which containers count as one)."""
    weight: dict[int, int] = defaultdict(int)
    depth, parent = {}, {}
    for containers, blocks in zip(pages, prose):
        own = [0] * len(containers)
        for b in blocks:
            if b.inside >= 0:
                own[b.inside] += len(b.text)
        at = []
        for up, _ in containers:
            at.append(at[up] + 1 if up >= 0 else 0)
        for k in range(len(own) - 1, -1, -1):  # containers are numbered as they open
            up, name = containers[k]
            weight[name] += own[k]
            depth[name], parent[name] = at[k], containers[up][1] if up >= 0 else -1
            if up >= 0:
                own[up] += own[k]
    total = sum(len(b.text) for blocks in prose for b in blocks)
    most = [(depth[k], k) for k, n in weight.items() if n and n * 4 >= total * 3]
    if not most:
        return -1, frozenset()
    main = up = max(most)[1]
    around = set()
    while (up := parent[up]) >= 0:
        around.add(up)
    return main, frozenset(around)


def learn(pages: list[Page]) -> Wrapper | None:
    """The wrapper of pages of one host; none from fewer than ``LEAST`` different ones."""
    pages = different(pages)
    if len(pages) < LEAST:
        return None
    fixed, lists = slots(infer([p.stream for p in pages]), len(pages))
    prose = [[b for b in p.blocks if not b.off and (b.path, b.text) not in fixed and not (b.linked * 2 > len(b.text) and b.path in lists)] for p in pages]
    plain = [[b for b in blocks if not b.names] for blocks in prose]
    size = lambda rows: sum(len(b.text) for blocks in rows for b in blocks)
    main, around = _weigh([p.containers for p in pages], plain if size(plain) * 2 >= size(prose) else prose)  # names that would switch off most of what varies say nothing here
    return Wrapper(fixed, lists, main, around)


def unnamed(page: Page, live: list[Block]) -> list[Block]:
    """Blocks outside elements that are off by name. If all main elements stand in such ones, those around the largest are on."""
    if all(b.names for b in live if b.main >= 0):
        weight: dict[int, int] = defaultdict(int)
        for b in live:
            if b.main >= 0 and b.names == page.main_names[b.main]:
                weight[b.main] += len(b.text)
        if weight:
            up, on = page.main_names[max(weight, key=lambda k: (weight[k], -k))], {0}
            while up > 0:
                on.add(up)
                up = page.names[up]
            return [b for b in live if b.names in on]
    return [b for b in live if not b.names]


def largest(blocks: list[Block]) -> list[Block]:
    """Those of the largest main element: lists of teasers in further ones are not the article."""
    inside: dict[int, int] = defaultdict(int)
    for b in blocks:
        inside[b.main] += len(b.text)
    best = max(inside, key=lambda k: (inside[k], -k))
    return [b for b in blocks if b.main == best]


def extract(html: str, wrapper: Wrapper | None = None) -> str:
    """Main text of a page, given its host's wrapper."""
    known = wrapper or Wrapper()
    page = parse(html, known.main)
    live = [b for b in page.blocks if not b.off and (b.path, b.text) not in known.fixed]
    at = [b for b in live if b.under >= 0 and b.names == b.under]
    if at:
        paths = [p for _, p in page.containers]
        if any(b.main >= 0 for b in at):
            best = largest([b for b in at if b.main >= 0])[0].main
            at = [b for b in at if b.main in (-1, best)]
        first = set(map(id, at))
        beside = lambda b: b.under < 0 and not b.names and b.main < 0 and b.inside >= 0 and paths[b.inside] in known.around
        return " ".join(b.text for b in live if (id(b) in first or beside(b)) and not (b.linked * 2 > len(b.text) and b.path in known.lists))
    live = unnamed(page, live)
    if any(b.main >= 0 for b in live):
        return " ".join(b.text for b in largest([b for b in live if b.main >= 0]))
    # else the innermost element that holds most of the text that is not links; links that follow one another are a list
    links = [b.linked * 2 > len(b.text) for b in live]
    prose = [b for k, b in enumerate(live) if not (links[k] and (k and links[k - 1] or links[k + 1 : k + 2] == [True]))]
    main, around = _weigh([[(up, k) for k, (up, _) in enumerate(page.containers)]], [[b for b in prose if b.linked * 2 <= len(b.text)]])
    if main < 0:
        return " ".join(b.text for b in prose)
    within = [False] * len(page.containers)
    for k, (up, _) in enumerate(page.containers):
        within[k] = k == main or up >= 0 and within[up]
    return " ".join(b.text for b in prose if b.inside >= 0 and (within[b.inside] or b.inside in around))


def _host(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


OUT = "page_id long, url string, text string, n_chars long"


def wrappers(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(host, wrapper) of the hosts that have one. A host's sample is its smallest page hashes, kept by pre-aggregated minima."""
    hashed = pages.select(_host(F.col(url_col)).alias("host"), F.xxhash64(F.col(id_col), F.col(html_col)).alias("k"), F.col(html_col).alias("html")).where(F.octet_length("html") > 0)
    # buckets by hash bound what one task holds: each gives its smallest page
    picked = hashed.groupBy("host", F.pmod(F.col("k"), F.lit(SAMPLE)).alias("bucket")).agg(F.min_by(F.struct("html"), "k").alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:  # rows are sorted by host
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                if host != now:
                    yield out(now, held)
                    now, held = host, []
                held.append(parse(page.as_py()))
        yield out(now, held)

    def out(host: str | None, held: list[Page]) -> pa.RecordBatch:
        found = learn(held)
        return pa.RecordBatch.from_arrays([pa.array([host] if found else [], pa.string()), pa.array([found.dump()] if found else [], pa.string())], ["host", "wrapper"])

    rows = picked.select("host", F.col("p.html").alias("html"), "bucket").repartition("host").sortWithinPartitions("host", "bucket")
    return rows.select("host", "html").mapInArrow(run, "host string, wrapper string")


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    ws = _runtime.Workspace(pages.sparkSession, "html")
    known = ws.put(wrappers(pages, id_col, url_col, html_col), "wrappers")
    size = known.agg(F.sum(F.octet_length("host") + F.octet_length("wrapper"))).first()[0]
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), _host(F.col(url_col)).alias("host"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read: dict[str, Wrapper] = {}
        for batch in batches:
            texts = []
            for page, said in zip(batch.column(2), batch.column(3).to_pylist()):
                if said is not None and said not in read:
                    if len(read) >= 256:
                        read.clear()
                    read[said] = Wrapper.load(said)
                texts.append(extract(page.as_py() or "", read.get(said)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.join(_runtime.beside(known, size or 0), "host", "left").select("page_id", "url", "html", "wrapper").mapInArrow(run, OUT)
