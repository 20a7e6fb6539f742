"""Benchmark decontamination by SimHash over item-sized windows.

A document is read in windows of as many words as a benchmark item has. The 128-bit SimHash of a window's five-word shingles is looked up in a
multi-index over the items' fingerprints: eight blocks of 16 bits. Two fingerprints within ``RADIUS`` = 39 bits differ in at most four bits in some block, so the
index, which lists for each block value the items within four bits of it, yields every item within the radius. Candidates within
the radius are verified exactly: the sum of the smaller shingle weights against the sum of the larger ones, weights being counts, must be
``similarity`` = 0.75 or more. At that similarity a fingerprint is beyond the radius with a probability of about 0.0001.

A window that shares no shingle with an item cannot verify, so only windows around shared shingles are fingerprinted, for the sizes of
the items that share them; this loses nothing. Documents are read in one pass without a shuffle. Items are a stated query set: they are sent to the tasks in
blocks of at most ``BLOCK_ITEMS`` items and ``BLOCK_BYTES`` bytes (or one longer item), whose sizes are checked first, and every block meets all documents.

A document shorter than an item is one window. Items and documents of one to four words have one shingle of all their words and match only
as a whole; null or empty ones match nothing. Repeated documents match alike; repeated items are reported each. For each document and item
the best window is given, the first of equals. Null ids pass through. Empty tables give no matches; other columns are not read by ``matches`` and
pass through ``clean`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _runtime, _text
from .lines import fresh

RADIUS, BLOCKS, SIMILARITY = 39, 8, 0.75
BLOCK_ITEMS, BLOCK_BYTES = 1000, 8 << 20
U64 = np.uint64
OUT = "doc_id long, item_id long, start_word long, n_words long, start_byte long, end_byte long, distance int, similarity double"
_OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start_word", pa.int64()), ("n_words", pa.int64()), ("start_byte", pa.int64()), ("end_byte", pa.int64()), ("distance", pa.int32()), ("similarity", pa.float64())])


def votes(h: np.ndarray) -> np.ndarray:
    """n+1 running sums, for each of 128 bits, of +1 or -1 by the shingles' hashes."""
    both = np.stack([h, _text.mix(h ^ U64(0x5DEECE66D))], 1).astype("<u8").view(np.uint8).reshape(len(h), 16)
    out = np.zeros((len(h) + 1, 128), np.int32)
    np.cumsum(np.unpackbits(both, axis=1).astype(np.int8) * 2 - 1, axis=0, dtype=np.int32, out=out[1:])
    return out


def fingerprints(total: np.ndarray) -> np.ndarray:
    """(n, 2) words of 64 bits from (n, 128) votes; a bit is set by a majority."""
    return np.packbits(total > 0, axis=1).view(U64).reshape(-1, 2)


class Items:
    """The items of one block, and the multi-index of their fingerprints."""

    def __init__(self, rows: list[tuple]) -> None:
        self.ids = [r[0] for r in rows]
        texts = pa.array([r[1] or "" for r in rows], pa.string())
        self.shingles, self.n_words = [], []
        for _, _, raw, offs in _text.chunks(texts):
            w = _text.words(raw, offs)
            s, first = _text.shingles(w)
            self.shingles += [s[a:b] for a, b in zip(first[:-1], first[1:])]
            self.n_words += np.diff(w.first).tolist()
        self.sets = [np.unique(s, return_counts=True) for s in self.shingles]
        self.size = np.array([len(s) for s in self.shingles], np.int64)
        self.prints = np.concatenate([fingerprints(votes(s)[-1:]) for s in self.shingles]) if rows else np.zeros((0, 2), U64)
        owner = np.repeat(np.arange(len(rows)), self.size)
        flat = np.concatenate(self.shingles) if rows else np.zeros(0, U64)
        pairs = np.unique(np.stack([flat, owner.astype(U64)], 1), axis=0) if len(flat) else np.zeros((0, 2), U64)
        self.known, at = np.unique(pairs[:, 0], return_index=True)
        self.first, self.owner = np.append(at, len(pairs)), pairs[:, 1].astype(np.int64)
        self.bitmap = np.zeros(1 << 20, bool)
        self.bitmap[self.known >> U64(44)] = True
        near = np.array([0, *(sum(1 << b for b in c) for k in range(1, RADIUS // BLOCKS + 1) for c in combinations(range(16), k))], np.uint16)
        self.index = []
        for v in self.prints.view(np.uint16).reshape(-1, BLOCKS).T:
            slot = (v[:, None] ^ near[None, :]).ravel()
            order = np.argsort(slot, kind="stable")
            item = np.repeat(np.arange(len(v), dtype=np.int32), len(near))[order]
            self.index.append((np.searchsorted(slot[order], np.arange(65537)), item))

    def hits(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of shingles that some item has, and which of ``known`` they are."""
        at = np.flatnonzero(self.bitmap[s >> U64(44)])
        k = np.minimum(np.searchsorted(self.known, s[at]), max(len(self.known) - 1, 0))
        ok = self.known[k] == s[at] if len(self.known) else np.zeros(len(at), bool)
        return at[ok], k[ok]

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All (window, item, distance) within the radius, by the blocks of the multi-index."""
        found = []
        for (ptr, item), v in zip(self.index, prints.view(np.uint16).reshape(-1, BLOCKS).T):
            n = ptr[v.astype(np.int64) + 1] - ptr[v]
            window = np.repeat(np.arange(len(v)), n)
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(ptr[v], n)
            found.append(window * len(self.ids) + item[place])
        pair = np.unique(np.concatenate(found))
        window, item = pair // len(self.ids), pair % len(self.ids)
        distance = np.bitwise_count(prints[window] ^ self.prints[item]).sum(1).astype(np.int64)
        ok = distance <= RADIUS
        return window[ok], item[ok], distance[ok]

    def similarity(self, window: np.ndarray, item: int) -> float:
        u, c = self.sets[item]
        at = np.minimum(np.searchsorted(u, window), len(u) - 1)
        both = int(np.minimum(np.bincount(at[u[at] == window], minlength=len(u)), c).sum())
        return both / (len(window) + len(self.shingles[item]) - both)


def search(items: Items, s: np.ndarray, at: np.ndarray, known: np.ndarray, similarity: float) -> list[tuple]:
    """(item, first shingle, shingles, distance, similarity): the best window of one document for each item."""
    best: dict[int, tuple] = {}
    named = np.concatenate([items.owner[items.first[k] : items.first[k + 1]] for k in np.unique(known)])
    for size in np.unique(items.size[named]):
        last = max(0, len(s) - size)
        lo, hi = np.maximum(at - size + 1, 0), np.minimum(at, last)
        lo = np.minimum(lo, hi)
        edge = np.zeros(last + 2, np.int32)
        np.add.at(edge, lo, 1)
        np.add.at(edge, hi + 1, -1)
        starts = np.flatnonzero(np.cumsum(edge)[: last + 1] > 0)
        for run in np.split(starts, np.flatnonzero(np.diff(starts) > size) + 1):
            for part in np.array_split(run, -(-len(run) // 4096)):
                a, b = int(part[0]), min(int(part[-1]) + int(size), len(s))
                c = votes(s[a:b])
                ends = np.minimum(part + size, len(s))
                window, item, distance = items.within(fingerprints(c[ends - a] - c[part - a]))
                ok = items.size[item] == size
                for w, i, d in zip(window[ok].tolist(), item[ok].tolist(), distance[ok].tolist()):
                    x, y = int(part[w]), int(ends[w])
                    sim = items.similarity(s[x:y], i)
                    if sim >= similarity and (i not in best or sim > best[i][4]):
                        best[i] = (i, x, y - x, d, sim)
    return [best[i] for i in sorted(best)]


_cache: dict[int, Items] = {}


def _block(docs: DataFrame, rows: list[tuple], similarity: float) -> DataFrame:
    """Matches of one block of items. The rows of the block, of a checked size, go with the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(tuple(rows))
        if key not in _cache:
            _cache.clear()
            _cache[key] = Items(rows)
        items = _cache[key]
        for batch in batches:
            out = []
            for a, b, raw, offs in _text.chunks(batch.column(1)):
                w = _text.words(raw, offs)
                s, first = _text.shingles(w)
                at, known = items.hits(s)
                doc = np.searchsorted(first, at, "right") - 1
                cut = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else []
                for x, y in zip(cut, np.append(cut[1:], len(doc)) if len(cut) else []):
                    d = int(doc[x])
                    for i, start, n, distance, sim in search(items, s[first[d] : first[d + 1]], at[x:y] - first[d], known[x:y], similarity):
                        n_words = min(n + _text.SHINGLE - 1, int(w.first[d + 1] - w.first[d]))
                        p = int(w.first[d]) + start
                        out.append((batch.column(0)[a + d].as_py(), items.ids[i], start, n_words, int(w.start[p] - offs[d]), int(w.end[p + n_words - 1] - offs[d]), distance, sim))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out) if out else [[]] * 8, _OUT.types)], schema=_OUT)

    return docs.mapInArrow(run, OUT)


def _blocks(items: DataFrame, max_items: int, max_bytes: int) -> Iterator[list[tuple]]:
    """All (id, text) in blocks. Equal texts go together with their ids; sizes are read before a block is: one that is too large is divided by other bits of its texts' hashes."""
    hashed = items.select("id", "x", F.xxhash64("x").alias("h"))
    todo = [(0, 0)]  # the texts whose hashes end in these bits
    while todo:
        bits, end = todo.pop()
        part = hashed.where(F.col("h").bitwiseAND((1 << bits) - 1) == end)
        n, size, texts = part.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("x") + 16), F.lit(0)), F.count_distinct("h")).first()
        if n > max_items or size > max_bytes:
            if texts > 1 and bits < 62:
                todo += [(bits + 1, end | 1 << bits), (bits + 1, end)]
                continue
            # one text, longer than a block or repeated more often: alone, and once for each run of its ids
            (text,) = part.select("x").first()
            for ids in _runs(part, max_items):
                yield [(i, text) for i in ids]
        elif n:
            yield sorted(((r.id, r.x) for r in part.collect()), key=repr)


def _runs(part: DataFrame, size: int) -> Iterator[list]:
    held = []
    for r in part.select("id").toLocalIterator():
        held.append(r.id)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, place and size of the window in words and bytes, distance, similarity) of every item found in a document."""
    _runtime.ship(docs.sparkSession)
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.coalesce(item_text_col, F.lit("")).alias("x"))
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("x"))
    out = None
    for rows in _blocks(items, BLOCK_ITEMS, BLOCK_BYTES):
        found = _block(read, rows, similarity)
        out = found if out is None else out.unionByName(found)
    return _block(read.where("false"), [], similarity) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    key, ws = fresh(docs, "leaked_id"), _runtime.Workspace(docs.sparkSession, "decontaminate")
    leaked = ws.put(matches(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias(key)).distinct(), "leaked")
    return docs.join(_runtime.beside(leaked, leaked.count() * 16), F.col(id_col).cast("long") == leaked[key], "left_anti")
