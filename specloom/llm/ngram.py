"""Language-model scoring with an Elias-Fano n-gram trie.

A level of the trie is a row of shards, each a file of compact arrays that scorers map into memory:

* ``key``: the level's n-grams as one growing sequence, context position times the number of successors there are plus the successor. Elias-Fano: low bits packed, high bits in unary.
* ``ptr``: for each context of the shard, where its successors begin: a monotone sequence, Elias-Fano.
* ``sum``: running counts, monotone, Elias-Fano; the deepest level needs none.
* ``prob``: log10 probability of each n-gram, and ``back``: log10 of the mass each context leaves to the shorter one; both in steps of ``STEP``.

The context of a level is a position in the level above. So is the successor: of a, b, c it is the position of b, c (in level 2, the word), which a search for the shorter context has found
already, and which gives the shorter probability without another search. Successors are sought relative to their context: the search goes to the
bucket of the key's high bits by a select on zeros and bisects its low bits. Level 1 holds hashes of words. The tokens of many texts are sought together, each
distinct word and n-gram once and in the order of the keys.

Smoothing: absolute discounting, interpolated with the shorter context, over all n-grams of the training part (``least`` = 1; a higher ``least`` leaves rarer ones of
two or more words out, and their mass goes to the shorter context). Single words have (c + 1) / (N + V + 1), so unknown words have the rest.

Counts come from all training texts: each batch is reduced to distinct n-grams, cut by shards and sent there as compressed
sorted runs, which a shard merges as a stream. Shards are cut by mass: each holds contexts of about ``shard_tokens`` occurrences; a context with more has several shards
of its own, by word, after a pass that sums what it leaves. Shard files lie in the shared folder under names of their own attempt; only those that a finished task
names are listed in the level's index file, so a lost executor's leavings do no harm. Tasks map the indexes; the driver learns their places and a few totals.

Null and empty texts are one end token. Repeated rows count and score each. Null doc_ids count as an empty text in the fold and pass through. An empty table gives no rows; a
training part without rows gives a model that knows no word. Other columns are not read.
"""

from __future__ import annotations

import json
import os
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _runtime, _text

U64 = np.uint64
STEP, DISCOUNT, ORDER, SHARD_TOKENS, MERGE = 0.0005, 0.75, 3, 2_000_000, 2_000_000
#: Tokens that are sought together.
TOGETHER = 900_000
#: Shards of the vocabulary hold about so many words.
SHARD_WORDS = 250_000
#: Shards that cannot be mapped, as their store is not mounted, are held in memory up to so many bytes for each level and worker.
HELD = 256 << 20
END = U64(0xE4D0E4D0E4D0E4D0)
_SELECT = np.zeros(256 * 8, U64)  # place of the k-th set bit of a byte
for _b in range(256):
    for _k, _at in enumerate([j for j in range(8) if _b >> j & 1]):
        _SELECT[_b * 8 + _k] = _at


_EACH, _TOP = U64(0x0101010101010101), U64(0x8080808080808080)  # the lowest and the highest bit of each byte


def _select_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th (from 0) set bit of each word, all bytes at a time."""
    k = k.astype(U64)
    sums = word - ((word >> U64(1)) & U64(0x5555555555555555))
    sums = (sums & U64(0x3333333333333333)) + ((sums >> U64(2)) & U64(0x3333333333333333))
    sums = ((sums + (sums >> U64(4))) & U64(0x0F0F0F0F0F0F0F0F)) * _EACH  # set bits up to each byte's end
    place = np.bitwise_count(((k * _EACH | _TOP) - sums) & _TOP).astype(U64) << U64(3)  # of the byte: eight for each one that ends before
    rank = k - (((sums << U64(8)) >> place) & U64(255))
    return (place + _SELECT[((word >> place) & U64(255)) << U64(3) | rank]).view(np.int64)


class EliasFano:
    """A non-decreasing sequence of n unsigned numbers below ``universe``: low bits packed, high bits in unary, a running count of ones for each word of 64 bits, and the word of
    every 16th one and zero. All arrays may be mapped; nothing is expanded."""

    SAMPLE = 4

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray, one: np.ndarray, zero: np.ndarray) -> None:
        self.n, self.bits, self.low, self.high, self.ones = n, bits, low, high, ones
        self.mask = U64((1 << bits) - 1)
        self.samples = {False: one, True: zero}

    def _before(self, word: np.ndarray, zeros: bool) -> np.ndarray:
        ones = self.ones[word].astype(np.int64)
        return word * 64 - ones if zeros else ones

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        v = values.astype(U64)
        low = np.zeros((n * bits + 63) // 64 + 1, U64)
        if bits and n:
            at = np.arange(n, dtype=np.int64) * bits
            word, shift = at >> 6, (at & 63).astype(U64)
            part = v & U64((1 << bits) - 1)
            np.bitwise_or.at(low, word, part << shift)
            over = (at & 63) + bits > 64
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (U64(64) - shift[over]))
        top = (v >> U64(bits)).astype(np.int64) + np.arange(n)
        words = (n + (universe >> bits) + 2 + 63) // 64 + 2
        unary = np.zeros(words * 64, bool)
        unary[top] = True
        high = np.packbits(unary, bitorder="little").view(U64)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])
        sampled = [np.append(np.searchsorted(c, np.arange(0, int(c[-1]) + 1, 1 << cls.SAMPLE), "right") - 1, len(c) - 2).astype(np.uint32) for c in (ones, np.arange(len(ones)) * 64 - ones)]
        return cls(n, bits, low, high, ones.astype(np.uint32), *sampled)

    def arrays(self) -> dict[str, np.ndarray]:
        return {"n": np.array([self.n, self.bits]), "low": self.low, "high": self.high, "ones": self.ones, "one": self.samples[False], "zero": self.samples[True]}

    @classmethod
    def load(cls, a: dict[str, np.ndarray]) -> EliasFano:
        return cls(int(a["n"][0]), int(a["n"][1]), *(a[k] for k in ("low", "high", "ones", "one", "zero")))

    def _select(self, k: np.ndarray, zeros: bool) -> np.ndarray:
        """Place of the k-th one or zero."""
        sample = self.samples[zeros]
        word = sample[k >> self.SAMPLE].astype(np.int64)
        behind = np.flatnonzero(self._before(word + 1, zeros) <= k)
        if len(behind):
            word[behind] += 1
            behind = behind[self._before(word[behind] + 1, zeros) <= k[behind]]
            lo, hi, want = word[behind], sample[(k[behind] >> self.SAMPLE) + 1].astype(np.int64), k[behind]
            while (lo < hi).any():  # among the many successors of a common context
                mid = (lo + hi + 1) >> 1
                ok = self._before(mid, zeros) <= want
                lo, hi = np.where(ok, mid, lo), np.where(ok, hi, mid - 1)
            word[behind] = lo
        chosen = self.high[word]
        return word * 64 + _select_in_word(~chosen if zeros else chosen, k - self._before(word, zeros))

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), U64)
        at = i * self.bits
        word, shift = at >> 6, (at & 63).view(U64)
        return ((self.low[word] >> shift) | (self.low[word + 1] << U64(1) << (U64(63) - shift))) & self.mask

    def get(self, i: np.ndarray) -> np.ndarray:
        high = (self._select(i, False) - i).astype(U64)
        return high << U64(self.bits) | self.lows(i)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Positions of the values x, -1 where absent."""
        out = np.full(len(x), -1, np.int64)
        if not self.n or not len(x):
            return out
        high = (x >> U64(self.bits)).astype(np.int64)
        # the bucket of equal high bits is the run of ones after the zero before it
        start = self._select(np.maximum(high - 1, 0), True) + 1
        start[high == 0] = 0
        run = ~(self.high[start >> 6] >> (start & 63).astype(U64))
        n = np.bitwise_count((run & (~run + U64(1))) - U64(1)).astype(np.int64)  # ones below the first zero
        lo = start - high
        hi = lo + n
        over = np.flatnonzero(n >= 64 - (start & 63))  # the run goes on in the next word
        if len(over):
            hi[over] = self._select(high[over], True) - high[over]
        todo = np.flatnonzero(lo < hi)
        lo, hi, want = lo[todo], hi[todo], x[todo] & self.mask
        while len(todo):
            mid = (lo + hi) >> 1
            got = self.lows(mid)
            same = np.flatnonzero(got == want)
            out[todo[same]] = mid[same]
            less = got < want
            lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid)
            hi[same] = 0  # found
            go = np.flatnonzero(lo < hi)
            todo, lo, hi, want = todo[go], lo[go], hi[go], want[go]
        return out


def _store(uri: str, arrays: dict[str, np.ndarray]) -> None:
    from pyarrow import fs

    head, at = {}, 0
    for k, a in arrays.items():
        head[k] = (a.dtype.str, len(a), at)
        at += (a.nbytes + 7) // 8 * 8
    line = json.dumps(head).encode()
    line += b" " * (-(len(line) + 8) % 8)
    where, path = fs.FileSystem.from_uri(uri)
    where.create_dir(os.path.dirname(path), recursive=True)
    with where.open_output_stream(path) as f:
        f.write(len(line).to_bytes(8, "little") + line)
        for a in arrays.values():
            f.write(np.ascontiguousarray(a).tobytes() + bytes(-a.nbytes % 8))


def _open(uri: str) -> tuple[dict[str, np.ndarray], int]:
    """The arrays of a file, and the bytes they hold in memory: none if mapped. What cannot be mapped is read into memory, never to a local disk."""
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri)
    if isinstance(where, fs.LocalFileSystem):
        m, held = np.memmap(path, np.uint8, "r").view(np.ndarray), 0
    else:
        with where.open_input_file(path) as f:
            m = np.frombuffer(f.read_buffer(), np.uint8)
        held = len(m)
    n = int.from_bytes(m[:8].tobytes(), "little")
    return {k: m[8 + n + at : 8 + n + at + np.dtype(t).itemsize * size].view(t) for k, (t, size, at) in json.loads(m[8 : 8 + n].tobytes()).items()}, held


def _parts(a: dict[str, np.ndarray], name: str) -> EliasFano:
    return EliasFano.load({k.split(".")[1]: v for k, v in a.items() if k.startswith(name + ".")})


def _order(context: np.ndarray, symbol: np.ndarray, contexts: int, symbols: int) -> np.ndarray:
    """Order by context, then by as much of the successor (-1 or more) as fits in one number of 64 bits beside context and place: such numbers sort faster than their places."""
    place_bits, context_bits, symbol_bits = len(context).bit_length(), contexts.bit_length(), (symbols + 1).bit_length()
    room = 64 - place_bits - context_bits
    if room < 0:
        return np.argsort(context)
    kept = min(room, symbol_bits)
    packed = (context.astype(U64) << U64(kept) | (symbol + 1).astype(U64) >> U64(symbol_bits - kept)) << U64(place_bits) | np.arange(len(context), dtype=U64)
    packed.sort()
    return (packed & U64((1 << place_bits) - 1)).view(np.int64)


class Level:
    """One level. Small when sent to tasks: the place of its index, and totals.

    The index lists the shards' files (none where no n-gram begins with their contexts) and where their entries begin among the level's positions. It also holds the cut of the level below:
    the first context of each stretch, and its number of shards: one, or several by word for the one context of a stretch.
    """

    def __init__(self, root: str, index: str, size: int, total: int, above: Level | None = None) -> None:
        self.root, self.index, self.size, self.total, self.above = root, index, size, total, above
        self.symbols = above.size if above else 0  # successors there are
        self.__setstate__(self.__dict__)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k[0] != "_"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._shards: OrderedDict[int, tuple] = OrderedDict()
        self._held, self._index = 0, None

    @property
    def listed(self) -> dict[str, np.ndarray]:
        if self._index is None:
            self._index = _open(self.index)[0]
        return self._index

    def stretch(self, context: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shard of the level below, first context of its stretch) for contexts of this level."""
        cut = self.listed
        e = np.searchsorted(cut["first"], context, "right") - 1
        shard, several = cut["shard"][e].astype(np.int64), np.flatnonzero(cut["pieces"][e] > 1)
        if len(several):
            shard[several] += ((_text.mix(symbol[several].astype(U64)) >> U64(33)).astype(np.int64) * cut["pieces"][e[several]]) >> 31
        return shard, cut["first"][e]

    def shard(self, k: int) -> dict | None:
        if k not in self._shards:
            name = self.listed["file"][k]
            if not name:
                return None
            a, held = _open(f"{self.root}/{name.decode()}")
            self._shards[k] = {x: _parts(a, x) for x in ("key", "sum") if f"{x}.n" in a} | {n: a[n] for n in ("prob", "back") if n in a}, held
            self._held += held
            while self._held > HELD and len(self._shards) > 1:
                self._held -= self._shards.popitem(last=False)[1][1]
        self._shards.move_to_end(k)
        return self._shards[k][0]

    @staticmethod
    def each(of: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(shard, rows) of the rows' shard numbers."""
        if not len(of):
            return
        order = np.argsort(of.astype(np.int16) if of.max() < 1 << 15 else of, kind="stable")
        cut = np.flatnonzero(np.append(True, of[order][1:] != of[order][:-1]))
        for a, b in zip(cut, np.append(cut[1:], len(of))):
            yield int(of[order[a]]), order[a:b]

    def gather(self, position: np.ndarray, name: str) -> np.ndarray:
        """prob or count of entries by position."""
        out = np.zeros(len(position), np.float64 if name == "prob" else np.int64)
        base = self.listed["base"]
        for k, rows in self.each(np.searchsorted(base, position, "right") - 1):
            s, at = self.shard(k), position[rows] - base[k]
            out[rows] = s["prob"][at] * -STEP if name == "prob" else (s["sum"].get(at + 1) - s["sum"].get(at)).astype(np.int64)
        return out

    def find(self, context: np.ndarray, symbol: np.ndarray, scored: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
        """Positions of (context, successor), -1 where absent; the log10 probability of what is there, and the log10 mass for shorter contexts of what is not (none unless ``scored``).
        Contexts of -1 have no successors and leave all. Pairs are sought in the order of the keys, so that neighbours in a shard follow each other; equal ones that lie together, once."""
        to = np.flatnonzero(context >= 0)
        to = to[_order(context[to], symbol[to], self.above.size, self.symbols)]
        c, s = context[to], symbol[to]
        new = np.append(True, (c[1:] != c[:-1]) | (s[1:] != s[:-1]))[: len(c)]
        c, s = c[new], s[new]
        at, coded = np.full(len(c), -1, np.int64), np.zeros(len(c), np.uint16)
        cut, base = self.above.listed, self.listed["base"]
        bound = np.append(np.searchsorted(c, cut["first"]), len(c))
        for e in np.flatnonzero(bound[1:] > bound[:-1]):
            a, b, first = int(bound[e]), int(bound[e + 1]), int(cut["first"][e])
            some = self.each(self.above.stretch(c[a:b], s[a:b])[0]) if cut["pieces"][e] > 1 else [(int(cut["shard"][e]), slice(None))]
            for k, rows in some:
                shard = self.shard(k)
                if shard is None:
                    continue
                own, sought = c[a:b][rows] - first, s[a:b][rows]
                value = shard["back"][own]
                got = np.flatnonzero((value > 0) & (sought >= 0))  # a context without successors leaves all
                found = shard["key"].find(own[got].astype(U64) * U64(self.symbols) + sought[got].astype(U64))
                hit = np.flatnonzero(found >= 0)
                there, found = got[hit], found[hit]
                place = np.full(len(own), -1, np.int64)
                place[there] = found + base[k]
                at[a:b][rows] = place
                if scored:
                    value[there] = shard["prob"][found]
                    coded[a:b][rows] = value
        del c, s
        of = np.cumsum(new) - 1
        position = np.full(len(context), -1, np.int64)
        position[to] = at[of]
        if not scored:
            return position, None
        out = np.zeros(len(context))
        out[to] = (coded * -STEP)[of]
        return position, out


class Model:
    """A vocabulary (level 1, by hash) and levels of longer n-grams."""

    def __init__(self, vocabulary: Level, bits: int, levels: list[Level], order: int, least: int) -> None:
        self.vocabulary, self.bits, self.levels, self.order, self.least = vocabulary, bits, levels, order, least
        self.tokens, self.n_words = vocabulary.total, vocabulary.size

    def words(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of word hashes, -1 if unknown, and their counts. Equal words that the order of the upper bits brings together are sought once."""
        place_bits = U64(len(h).bit_length())
        order = (np.sort(h >> place_bits << place_bits | np.arange(len(h), dtype=U64)) & ((U64(1) << place_bits) - U64(1))).view(np.int64)
        x = h[order]
        new = np.append(True, x[1:] != x[:-1])[: len(x)]
        x = x[new]
        got, n = np.full(len(x), -1, np.int64), np.zeros(len(x), np.int64)
        v, low = self.vocabulary, x & U64((1 << (64 - self.bits)) - 1)
        for k, rows in v.each((x >> U64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(x), np.int64)):
            if v.shard(k):
                at = v.shard(k)["key"].find(low[rows])
                got[rows] = np.where(at >= 0, at + v.listed["base"][k], -1)
        known = np.flatnonzero(got >= 0)
        n[known] = v.gather(got[known], "count")
        of = np.cumsum(new) - 1
        ids, counts = np.empty(len(h), np.int64), np.empty(len(h), np.int64)
        ids[order], counts[order] = got[of], n[of]
        return ids, counts

    def lasting(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Ids of words that can be in longer n-grams."""
        return np.where(counts >= self.least, ids, -1) if self.least > 1 else ids

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.tokens + self.n_words + 1))

    def walk(self, ids: np.ndarray, begins: np.ndarray, unigram: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """(context of each token at the level below the deepest, its successor there, log10 probability of each token, from that of ``unigram``; none without it).

        ``begins``: where texts begin. The context of a text's first token is the end token; no context crosses a text.
        """
        end = self.words(np.array([END]))[0][0]
        before = np.concatenate([[end], ids[:-1]])
        before[begins] = end
        score, inner, symbol = unigram, before, ids
        for level in self.levels:
            position, value = level.find(inner, symbol, score is not None)
            if score is not None:
                score = np.where(position >= 0, value, value + score)
            inner = np.concatenate([[-1], position[:-1]])
            inner[begins] = -1
            symbol = position
        return inner, symbol, score


def tokens(w: _text.Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of a chunk, with an end after each text; n+1 offsets."""
    n = len(w.first) - 1
    first = w.first + np.arange(n + 1)
    out = np.full(first[-1], END, U64)
    out[np.arange(len(w.hash)) + np.repeat(np.arange(n), np.diff(w.first))] = w.hash
    return out, first


def _chunks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tokens and offsets of runs of whole texts with about ``TOGETHER`` tokens: the more are sought together, the nearer their entries lie and the more of them a shard has."""
    held, size = [], 0
    for _, _, raw, offs in _text.chunks(column, 1 << 21):
        held.append(tokens(_text.words(raw, offs)))
        size += len(held[-1][0])
        if size >= TOGETHER:
            yield _joined(held)
            held, size = [], 0
    if held:
        yield _joined(held)


def _joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    before = np.cumsum([0, *(len(h) for h, _ in parts)])
    return np.concatenate([h for h, _ in parts]), np.concatenate([[0], *(first[1:] + b for (_, first), b in zip(parts, before))])


def _quantised(x: np.ndarray) -> np.ndarray:
    return np.clip(np.round(-x / STEP), 0, 65535).astype(np.uint16)


_MADE = "shard long, file string, size long, total long, first array<long>, pieces array<int>"
_MADE_PA = pa.schema([("shard", pa.int64()), ("file", pa.string()), ("size", pa.int64()), ("total", pa.int64()), ("first", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32()))])


def _write(root: str, level: int, shard: int, coded: dict[str, EliasFano], plain: dict[str, np.ndarray], n: np.ndarray, cut: int) -> tuple:
    """Stores a shard; its row for the index. The level below is cut into stretches of about ``cut`` occurrences; a more frequent context is a stretch with several shards."""
    file = f"level-{level}/{shard:06d}-{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:8]}"
    _store(f"{root}/{file}", {f"{a}.{b}": v for a, e in coded.items() for b, v in e.arrays().items()} | plain)
    block = (np.cumsum(n) - 1) // cut
    hot = np.flatnonzero(n > cut)
    first = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, hot, hot + 1]))
    first = first[first < len(n)]
    return shard, file, len(n), int(n.sum()), first.tolist(), np.maximum(-(-n[first] // cut), 1).tolist() if len(n) else []


def _made(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(_MADE_PA), _MADE_PA.types)], schema=_MADE_PA)


def _index(ws: _runtime.Workspace, made: DataFrame, root: str, level: int, n_shards: int, above: Level | None) -> Level:
    """The level whose shards ``made`` lists. One task writes the index; a few numbers for each shard pass through it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, size, first, pieces, total = [""] * n_shards, np.zeros(n_shards, np.int64), {}, {}, 0
        for b in batches:
            for r in b.to_pylist():
                files[r["shard"]], size[r["shard"]], first[r["shard"]], pieces[r["shard"]] = r["file"], r["size"], r["first"], r["pieces"]
                total += r["total"]
        base = np.concatenate([[0], np.cumsum(size)])
        cut = [np.concatenate([np.zeros(0, np.int64), *(np.array(first[k], np.int64) + base[k] for k in sorted(first))]), np.concatenate([np.zeros(0, np.int64), *(np.array(pieces[k], np.int64) for k in sorted(pieces))])]
        name = f"{root}/level-{level}/index-{uuid.uuid4().hex[:8]}"
        n_next = int(cut[1].sum())
        _store(name, {"file": np.array([f.encode() for f in files] or [b""], "S"), "base": base, "first": cut[0], "pieces": cut[1], "shard": np.cumsum(cut[1]) - cut[1]})
        widest = int(np.diff(np.append(cut[0], base[-1])).max(initial=1))
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (name, int(base[-1]), total, n_next, bool((cut[1] > 1).any()), widest)], ["index", "size", "total", "n_next", "hot", "widest"])

    r = ws.put(made.coalesce(1).mapInArrow(run, "index string, size long, total long, n_next long, hot boolean, widest long"), f"index-{level}").first()
    if r is None:  # no row at all
        name = f"{root}/level-{level}/index-none"
        _store(name, {"file": np.array([b""] * max(n_shards, 1), "S1"), "base": np.zeros(n_shards + 1, np.int64), **{k: np.zeros(0, np.int64) for k in ("first", "pieces", "shard")}})
        out, out.n_next, out.hot, out.widest = Level(root, name, 0, 0, above), 0, False, 1
        return out
    out = Level(root, r["index"], r["size"], r["total"], above)
    out.n_next, out.hot, out.widest = r["n_next"], r["hot"], r["widest"]
    return out


def _vocabulary(ws: _runtime.Workspace, texts: DataFrame, root: str, cut: int) -> tuple[Level, int]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, n in _merged(np.unique(h, return_counts=True) for batch in batches for h, _ in _chunks(batch.column(0))):
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    counted = ws.put(texts.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "words")
    bits = max(0, int(counted.count() // min(cut, SHARD_WORDS)).bit_length())

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        t = pa.Table.from_batches(held)
        shard, h, n = t.column(0).to_numpy(), t.column(1).to_numpy().view(U64), t.column(2).to_numpy()
        rows = []
        for k in np.unique(shard):
            x = (h[shard == k]) & U64((1 << (64 - bits)) - 1)
            order = np.argsort(x)
            own = n[shard == k][order]
            sums = np.concatenate([[0], np.cumsum(own)])
            rows.append(_write(root, 1, int(k), {"key": EliasFano.build(x[order], 1 << (64 - bits)), "sum": EliasFano.build(sums, int(sums[-1]) + 1)}, {}, own, cut))
        yield _made(rows)

    shard = F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long")
    made = counted.select(shard.cast("long").alias("shard"), "h", "n").repartition(max(1, 1 << bits), "shard").mapInArrow(build, _MADE)
    out = _index(ws, ws.put(made, "vocabulary"), root, 1, 1 << bits, None)
    ws.drop(counted)
    return out, bits


def _runs(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """A compressed sorted run: byte planes of the gaps, then the counts."""
    gaps = np.diff(keys, prepend=U64(0))
    planes = np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(planes + counts.astype("<u4").tobytes())


def _unrun(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    n = len(raw) // 12
    return np.cumsum(np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view(U64).ravel(), dtype=U64), raw[8 * n :].view("<u4").astype(np.int64)


def _merge(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Sums the counts, the last array of each part, of equal keys, the arrays before it; in the order of the keys."""
    if len(parts) == 1:
        return parts[0]
    *keys, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.zeros(len(n), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(new)
    return *(k[at] for k in keys), np.add.reduceat(n[order], at) if len(n) else n


def _merged(parts: Iterator[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
    """Merged counts of as many parts at a time as hold MERGE keys, so that memory does not follow a batch."""
    held, size = [], 0
    for p in parts:
        held.append(p)
        size += len(p[0])
        if size >= MERGE:
            yield _merge(held)
            held, size = [], 0
    if held:
        yield _merge(held)


def _next_level(ws: _runtime.Workspace, texts: DataFrame, root: str, model: Model, shard_tokens: int) -> Level:
    """The level below the deepest one of ``model``, from the counts of its n-grams in all texts."""
    level, above = len(model.levels) + 2, model.levels[-1] if model.levels else model.vocabulary
    n_shards, word_bits = above.n_next, above.size.bit_length()
    # an n-gram's key in its shard: the context, counted from the stretch's first, then the successor; with the shard before it where all three fit in 64 bits
    key_bits = word_bits + above.widest.bit_length()
    together = key_bits + n_shards.bit_length() <= 64

    def counted(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        ids = model.lasting(*model.words(h))
        context, symbol, _ = model.walk(ids, first[:-1])
        ok = np.flatnonzero((context >= 0) & (symbol >= 0))
        shard, begin = above.stretch(context[ok], symbol[ok])
        key = (context[ok] - begin).astype(U64) << U64(word_bits) | symbol[ok].astype(U64)
        if together:
            return np.unique(shard.astype(U64) << U64(key_bits) | key, return_counts=True)
        return _merge([(shard[:0], key[:0], shard[:0]), (shard, key, np.ones(len(key), np.int64))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *keys, n in _merged(counted(h, first) for batch in batches for h, first in _chunks(batch.column(0))):
            shard, key = ((keys[0] >> U64(key_bits)).astype(np.int64), keys[0] & U64((1 << key_bits) - 1)) if together else keys
            cut = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else np.zeros(0, np.int64)
            several = above.listed["pieces"][np.searchsorted(above.listed["shard"], shard[cut], "right") - 1] > 1
            runs = [_runs(key[a:b], n[a:b]) for a, b in zip(cut, np.append(cut[1:], len(shard)))]
            yield pa.RecordBatch.from_arrays([pa.array(shard[cut]), pa.array(several), pa.array(runs, pa.binary())], ["shard", "several", "run"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, keys, counts) of each shard; rows come sorted by shard."""
        now, held, size = None, [], 0
        for batch in batches:
            for k, run in zip(batch.column(0).to_pylist(), batch.column(1)):
                if k != now:
                    if now is not None:
                        yield now, *_merge(held)
                    now, held, size = k, [], 0
                held.append(_unrun(run.as_buffer()))
                size += len(held[-1][0])
                if size > MERGE and len(held) > 1:  # what stays is at most the distinct n-grams
                    held = [_merge(held)]
                    size = 0  # what comes next is merged once it is as much again
        if now is not None:
            yield now, *_merge(held)

    def begin(shard: int) -> tuple[int, int, bool]:
        """First and end context of a shard's stretch, and whether it is one of several of its context."""
        cut = above.listed
        e = int(np.searchsorted(cut["shard"], shard, "right")) - 1
        return int(cut["first"][e]), int(cut["first"][e + 1]) if e + 1 < len(cut["first"]) else above.size, bool(cut["pieces"][e] > 1)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(begin(k)[0], float((n[n >= model.least] - DISCOUNT).sum())) for k, _, n in merged(batches)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.float64())], ["context", "seen"])

    runs = ws.put(texts.mapInArrow(count, "shard long, several boolean, run binary"), f"runs-{level}")
    dealt = lambda df: df.select("shard", "run").repartition(max(1, n_shards), "shard").sortWithinPartitions("shard")
    frequent = None
    if above.hot:  # what the shards of one frequent context have in common
        frequent = f"{root}/level-{level}/frequent-{uuid.uuid4().hex[:8]}"

        def note(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(list(batches), pa.schema([("context", pa.int64()), ("seen", pa.float64())])).sort_by("context")
            _store(frequent, {"context": t.column(0).to_numpy(), "seen": t.column(1).to_numpy()})
            yield pa.RecordBatch.from_arrays([pa.array([len(t)])], ["n"])

        own = ws.put(dealt(runs.where("several")).mapInArrow(seen, "context long, seen double").groupBy("context").agg(F.sum("seen").alias("seen")), f"frequent-{level}")
        own.coalesce(1).mapInArrow(note, "n long").collect()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _open(frequent)[0] if frequent else None
        for k, keys, n in merged(batches):
            lo, hi, several = begin(k)
            total = float(known["seen"][np.searchsorted(known["context"], lo)]) if several else None
            yield _made([_shard(root, level, k, model, keys, n, lo, hi, word_bits, total, shard_tokens)])

    made = ws.put(dealt(runs).mapInArrow(build, _MADE), f"level-{level}")
    ws.drop(runs)
    return _index(ws, made, root, level, n_shards, above)


def _shard(root: str, level: int, shard: int, model: Model, keys: np.ndarray, n: np.ndarray, lo: int, hi: int, word_bits: int, all_seen: float | None, cut: int) -> tuple:
    """Smooths and writes the n-grams of contexts lo to hi. ``all_seen``: the discounted counts of a context with several shards."""
    if model.least > 1:
        keys, n = keys[n >= model.least], n[n >= model.least]
    above = model.levels[-1] if model.levels else model.vocabulary
    context, symbol = (keys >> U64(word_bits)).astype(np.int64), (keys & U64((1 << word_bits) - 1)).astype(np.int64)
    new = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(context) else np.zeros(0, np.int64)
    parents, of = context[new], np.repeat(np.arange(len(new)), np.diff(np.append(new, len(context))))
    total = above.gather(parents + lo, "count")
    shorter = above.gather(symbol, "prob") if model.levels else model.base(above.gather(symbol, "count"))
    seen = (n - DISCOUNT) / total[of]
    left = np.bincount(of, weights=seen, minlength=len(parents)) if all_seen is None else np.full(len(parents), all_seen) / total
    left = np.maximum(1 - left, 1e-6)
    prob = np.log10(seen + left[of] * 10**shorter)
    back = np.zeros(hi - lo, np.uint16)
    back[parents] = np.maximum(_quantised(np.log10(left)), 1)
    if all_seen is not None:  # successors of other shards are sought here too
        back[:] = back.max(initial=1)
    key = context.astype(U64) * U64(above.size) + symbol.astype(U64)
    coded = {"key": EliasFano.build(key, max(1, (hi - lo) * above.size)), "ptr": EliasFano.build(np.searchsorted(context, np.arange(hi - lo + 1)), len(key) + 1)}
    if level < model.order:
        sums = np.concatenate([[0], np.cumsum(n)])
        coded["sum"] = EliasFano.build(sums, int(sums[-1]) + 1)
    return _write(root, level, shard, coded, {"prob": _quantised(prob), "back": back}, n, cut)


def train(texts: DataFrame, text_col: str = "text", order: int = ORDER, least: int = 1, shard_tokens: int = SHARD_TOKENS) -> Model:
    """A model of all rows of ``texts``; its files stay in the shared folder."""
    assert order in (1, 2, 3) and least >= 1
    ws = _runtime.Workspace(texts.sparkSession, "ngram")
    x = texts.select(F.col(text_col).alias("x"))
    root = f"{ws.root}/trie"
    if "://" not in root:
        root = root.replace("file:", "file://") if root.startswith("file:") else f"file://{root}"
    vocabulary, bits = _vocabulary(ws, x, root, shard_tokens)
    model = Model(vocabulary, bits, [], order, least)
    for _ in range(order - 1):
        if (model.levels[-1] if model.levels else vocabulary).size:
            model.levels.append(_next_level(ws, x, root, model, shard_tokens))
    return model


OUT = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """n_tokens, n_known, train_tokens, base_score and score of each text."""
    _runtime.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for h, first in _chunks(batch.column(1)):
                ids, n = model.words(h)
                base = model.base(n)
                *_, p = model.walk(model.lasting(ids, n), first[:-1], base)
                got.append((np.diff(first), _text.reduce_sum((ids >= 0).astype(np.int64), first), _text.reduce_sum(base, first), _text.reduce_sum(p, first)))
            cols = [np.concatenate(c) for c in zip(*got)] if got else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0]), pa.array(cols[1]), pa.array(np.full(len(cols[0]), model.tokens)), pa.array(cols[2]), pa.array(cols[3])], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("x")).mapInArrow(run, OUT)


def fold(id_col: Column, k: int) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % k


def held_out_scores(spark: SparkSession, docs: DataFrame, folds: int = 7, held: int = 2, order: int = ORDER, least: int = 1) -> DataFrame:
    """Scores of all ``docs`` by a model of those outside the held fold."""
    model = train(docs.where(fold(F.col("doc_id"), folds) != held), order=order, least=least)
    return score(docs, model).withColumn("held_out", fold(F.col("doc_id"), folds) == held)
