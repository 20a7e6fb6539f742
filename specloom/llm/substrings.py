"""Suffix-array dedup: bytes of texts that lie in a repeated string of ``length`` bytes.

1. Anchors. Every string of ``length`` bytes belongs to the ``GRAM``-byte string in it with the smallest hash (the first of equal ones), so copies belong to copies of
   one anchor, at one offset, and strings need comparing only among the places of one anchor. The strings of one place all differ.
2. Anchors that occur once are dropped by a count; the others are sent, with the bytes of the strings that belong to them, to the shard of their hash.
   Equal runs of bytes are kept once there, compared by their bytes.
3. In a shard, suffixes are sorted by their first ``length`` bytes, and the longest common prefixes of neighbours are read off the bytes, up to ``length``.
   Positions count in document order, then by place. One pass over the suffix array finds each suffix's previous and next smaller position in suffix order and its
   common prefix with both; the longer one is its longest previous factor. Where this reaches ``length``, the string is a copy of an earlier one.
   ``keep="first"`` removes such strings; ``keep="none"`` also the earlier ones they copy, that is, all copies.
4. The union of removed strings is cut out of each text. Equal texts are found by 128 bits of hashes and length and treated as one.

An anchor with more than ``max_windows`` strings is not gathered in one task: its strings are counted by a 128-bit hash in pre-aggregated rows instead, with the same result.

Texts are judged as UTF-8 bytes, whole, on the input; strings never cross texts. Null texts are empty. Texts shorter than ``length`` lose nothing.
Rows with equal texts have equal results under ``keep="none"``; under ``keep="first"`` those with the smallest doc_id count as the first. Null doc_ids pass through and come first.
An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _runtime, _text

LENGTH, GRAM, MAX_WINDOWS, CHUNK, SLAB, BATCH = 200, 40, 1 << 18, 1 << 18, 2 << 20, 1 << 15
U64 = np.uint64
_ODD = U64(0x9FB21C651E98DF25)


def gram_hashes(raw: np.ndarray, gram: int, seed: int = 0) -> np.ndarray:
    """The hash of every string of ``gram`` (8 or more) bytes, eight bytes at a time; the last eight may overlap those before."""
    wide, n = _text.eights(raw), len(raw) - gram + 1
    h = np.full(n, U64(seed), U64)
    for k in [*range(0, gram - 8, 8), gram - 8]:
        h ^= wide[k : k + n]
        h *= _ODD
        h ^= h >> U64(29)
    return _text.mix(h)


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over x[i : i + width]."""
    m, size = x, 1
    while size * 2 <= width:
        m = op(m[:-size], m[size:])
        size *= 2
    return op(m[: len(x) - width + 1], m[width - size :][: len(x) - width + 1]) if size < width else m


def anchors(raw: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, place of the first string that belongs to it, number of such strings, hash) of every anchor. The strings of an anchor follow one another."""
    width, n = length - gram + 1, len(raw)
    size = np.diff(offs)
    if not (size >= length).any():
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(U64)
    full = gram_hashes(raw, gram)
    ranked = (full >> U64(32) << U64(32)) | np.arange(len(full), dtype=U64)
    owner = (_sliding(ranked, width, np.minimum) & U64(0xFFFFFFFF)).astype(np.int64)
    inside = np.zeros(n + 1, np.int32)  # strings that would cross texts do not count
    fits = size >= length
    np.add.at(inside, offs[:-1][fits], 1)
    np.add.at(inside, offs[1:][fits] - length + 1, -1)
    start = np.flatnonzero(np.cumsum(inside)[: len(owner)] > 0)
    own = owner[start]
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    place = start[first]
    text = np.searchsorted(offs, place, "right") - 1
    return text, place - offs[text], np.diff(np.append(first, len(own))), full[own[first]]


def suffix_array(raw: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at ``start`` (increasing) in the order of their first ``length`` bytes, equal ones by position, and the common prefix of each with the one before it (0 for the first)."""
    n, width = len(start), -(-length // 8) * 8
    if width == length:
        rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, length)[start])
    else:
        rows = np.zeros((n, width), np.uint8)
        rows[:, :length] = np.lib.stride_tricks.sliding_window_view(raw, length)[start]
    order = _sorted(rows)
    blocks = rows.view(U64)[order]
    lcp = np.zeros(n, np.int64)
    differ = blocks[1:] ^ blocks[:-1]
    first = (differ != 0).argmax(1)
    x = differ[np.arange(n - 1), first]
    lcp[1:] = np.where(x == 0, length, first * 8 + (np.bitwise_count((x & (~x + U64(1))) - U64(1)) >> 3))
    return order, lcp


def _sorted(rows: np.ndarray) -> np.ndarray:
    """The stable order of rows of bytes: by their first eight bytes, and ties by all."""
    key = rows.view(">u8")[:, 0].astype(U64)
    order = np.argsort(key, kind="stable")
    tied = np.append(False, key[order][1:] == key[order][:-1])
    tied[:-1] |= tied[1:]
    at = np.flatnonzero(tied)
    if len(at):
        some = np.sort(order[at])
        column = pa.FixedSizeBinaryArray.from_buffers(pa.binary(rows.shape[1]), len(some), [None, pa.py_buffer(np.ascontiguousarray(rows[some]))])
        order[at] = some[pc.array_sort_indices(column).to_numpy()]
    return order


def previous_factors(suffixes: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By position: the previous and the next smaller position in suffix order (-1 without any), the length of the longest previous factor and where it lies.

    One pass with a stack of positions that wait for a smaller one; each carries its common prefix with the one below it, its previous smaller position.
    """
    n = len(suffixes)
    before, after, factor, source = [-1] * n, [-1] * n, [0] * n, [-1] * n
    waiting, shared = [], []
    for at, common in zip([*suffixes.tolist(), -1], [*lcp.tolist(), 0]):
        while waiting and waiting[-1] > at:
            top, below = waiting.pop(), shared.pop()
            after[top] = at
            if common > below:
                factor[top], source[top], common = common, at, below
            else:
                factor[top], source[top] = below, before[top]
        if at >= 0:
            before[at] = waiting[-1] if waiting else -1
            waiting.append(at)
            shared.append(common if len(waiting) > 1 else 0)
    return tuple(np.array(x, np.int64) for x in (before, after, factor, source))


def repeated_windows(raw: np.ndarray, first: np.ndarray, size: np.ndarray, length: int, keep: str) -> tuple[np.ndarray, np.ndarray]:
    """Of each run of bytes, the places of its first and last string that is repeated (the last is -1 without any). Runs stand in global order."""
    per = size - length + 1
    owner = np.repeat(np.arange(len(size)), per)
    place = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    _, _, factor, source = previous_factors(*suffix_array(raw, first[owner] + place, length))
    hit = factor >= length
    if keep == "none":
        hit[source[hit]] = True
    lo, hi = np.full(len(size), 1 << 40), np.full(len(size), -1)
    np.minimum.at(lo, owner[hit], place[hit])
    np.maximum.at(hi, owner[hit], place[hit])
    return lo, hi


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    x = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(x).alias("k1"), (F.shiftleft(F.octet_length(x).cast("long"), 32) + F.crc32(x.cast("binary"))).alias("k2"), x.alias("x"))


def _anchor_rows(rows: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, raw, offs in _text.chunks(batch.column(2), CHUNK):
                text, place, n, fp = anchors(raw, offs, length, gram)
                take = pa.array(text + a)
                yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), batch.column(0).take(take), batch.column(1).take(take), pa.array(place.astype(np.int32)), pa.array(n.astype(np.int32))], ["fp", "k1", "k2", "place", "n"])

    return rows.select("k1", "k2", "x").mapInArrow(run, "fp long, k1 long, k2 long, place int, n int")


def _context_rows(rows: DataFrame, length: int) -> DataFrame:
    """Rows k1, k2, id, x, places -> for each anchor the bytes of the strings that belong to it."""
    names = ["fp", "hot", "id", "k1", "k2", "start", "context"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column(4)
            bounds = places.offsets.to_numpy()
            flat = places.values
            place, n, fp = (flat.field(k).to_numpy().astype(np.int64) for k in range(3))
            hot = flat.field(3)
            for a, b, raw, offs in _text.chunks(batch.column(3), CHUNK):
                lo, hi = bounds[a], bounds[b]
                text = np.repeat(np.arange(a, b), np.diff(bounds[a : b + 1]))
                start, size = offs[text - a] + place[lo:hi], n[lo:hi] + length - 1
                for x in range(0, hi - lo, 8192):
                    y = min(x + 8192, hi - lo)
                    s, z = start[x:y], size[x:y]
                    at = np.concatenate([[0], np.cumsum(z)])
                    data = raw[np.arange(at[-1]) + np.repeat(s - at[:-1], z)]
                    context = pa.Array.from_buffers(pa.binary(), y - x, [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
                    take = pa.array(text[x:y])
                    yield pa.RecordBatch.from_arrays([pa.array(fp[lo + x : lo + y]), hot.slice(lo + x, y - x), *(batch.column(k).take(take) for k in (2, 0, 1)), pa.array(place[lo + x : lo + y]), context], names)

    return rows.select("k1", "k2", "id", "x", "places").mapInArrow(run, "fp long, hot boolean, id long, k1 long, k2 long, start long, context binary")


def _shard(contexts: DataFrame, length: int, keep: str) -> DataFrame:
    """(k1, k2, start, end) of the removed bytes among the strings of each anchor; rows come sorted by fp, id, k1, k2, start."""

    def slab(t: pa.Table) -> pa.RecordBatch:
        fp, k1, k2, start = (t.column(k).to_numpy() for k in (0, 2, 3, 4))
        context = t.column(5).combine_chunks()
        raw, offs = _text.buffers(context)
        size, n = np.diff(offs), len(fp)
        group = np.cumsum(np.append(True, fp[1:] != fp[:-1])) - 1
        again = np.append(False, (fp[1:] == fp[:-1]) & (k1[1:] == k1[:-1]) & (k2[1:] == k2[:-1]) & (start[1:] == start[:-1]))  # a repeated row
        code = context.dictionary_encode().indices.to_numpy()  # equal bytes, equal code
        firsts, unique = (x.astype(np.int64) for x in np.unique(code, return_index=True, return_inverse=True)[1:])
        unique = firsts[unique]
        firsts = np.sort(firsts)
        times = np.bincount(unique[~again], minlength=n)
        lo, hi = np.zeros(n, np.int64), np.full(n, -1)
        per_group = np.bincount(group[firsts], minlength=int(group[-1]) + 1)
        for part in _parts(firsts[per_group[group[firsts]] > 1], group, size - length + 1):
            lo[part], hi[part] = repeated_windows(raw, offs[part], size[part], length, keep)
        if keep == "none":
            more = firsts[times[firsts] > 1]
            lo[more], hi[more] = 0, size[more] - length
            lo, hi = lo[unique], hi[unique]
        else:
            later = unique != np.arange(n)
            lo[later], hi[later] = 0, size[later] - length
        ok = (hi >= 0) & ~again
        return pa.RecordBatch.from_arrays([pa.array(x[ok]) for x in (k1, k2, start + lo, start + hi + length)], ["k1", "k2", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size < 2 * SLAB:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            fp = t.column(0).to_numpy()
            n = int(np.searchsorted(fp, fp[-1], "left")) if fp[0] != fp[-1] else 0  # rows are sorted by fp
            if n:
                yield slab(t.slice(0, n))
                t = t.slice(n)
                size = t.nbytes
            held = t.to_batches()
        if held:
            yield slab(pa.Table.from_batches(held).combine_chunks())

    return contexts.mapInArrow(run, "k1 long, k2 long, start long, end long")


def _parts(rows: np.ndarray, group: np.ndarray, windows: np.ndarray) -> Iterator[np.ndarray]:
    """Runs of whole groups with about BATCH strings."""
    if not len(rows):
        return
    cut = np.flatnonzero(np.append(True, group[rows][1:] != group[rows][:-1]))
    at = np.cumsum(windows[rows])
    a = 0
    for b in np.append(cut[1:], len(rows)):
        if at[b - 1] - (at[a - 1] if a else 0) >= BATCH or b == len(rows):
            yield rows[a:b]
            a = b


def _counted(ws: _runtime.Workspace, contexts: DataFrame, length: int, keep: str) -> DataFrame:
    """As ``_shard``, for anchors with too many places to gather: one row for each string, counted by a 128-bit hash."""

    def both(raw: np.ndarray) -> list[np.ndarray]:
        """Two 64-bit hashes of each string, from those of its parts of 8 to 64 bytes."""
        out, n, gram = [], len(raw) - length + 1, min(64, length)
        for seed in (1, 2):
            part, h = gram_hashes(raw, gram, seed), np.full(n, U64(seed), U64)
            for k in [*range(0, length - gram, gram), length - gram]:
                h = _text.mix(h ^ part[k : k + n])
            out.append(h.view(np.int64))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, k1, k2, start, x in zip(*(batch.column(k).to_pylist() for k in range(5))):
                h1, h2 = both(np.frombuffer(x, np.uint8))
                n = len(h1)
                yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array([i] * n, pa.int64()), *(pa.array(np.full(n, v)) for v in (k1, k2)), pa.array(np.arange(start, start + n))], ["h1", "h2", "id", "k1", "k2", "start"])

    rows = ws.put(contexts.select("id", "k1", "k2", "start", "context").mapInArrow(run, "h1 long, h2 long, id long, k1 long, k2 long, start long").distinct(), "strings")
    counts = ws.put(rows.groupBy("h1", "h2").agg(F.min(F.struct("id", "k1", "k2", "start")).alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1"), "string-counts")
    found = rows.join(counts.hint("merge"), ["h1", "h2"])
    if keep == "first":
        found = found.where(F.struct("id", "k1", "k2", "start") != F.col("first"))
    return found.select("k1", "k2", "start", (F.col("start") + length).alias("end"))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, keep: str = "none", max_windows: int = MAX_WINDOWS) -> DataFrame:
    """id, k1, k2, x, whole (the text is a copy to be removed as a whole) and spans (removed ranges, unmerged; null if none), for each row."""
    assert keep in ("none", "first") and 8 <= gram < length
    ws = _runtime.Workspace(docs.sparkSession, "substrings")
    rows, key = _keyed(docs, id_col, text_col), ["k1", "k2"]
    copies = ws.put(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("id"))["id"].alias("first_id")).where("c > 1"), "copies")
    places = ws.put(_anchor_rows(rows.where(F.octet_length("x") >= length), length, gram), "anchors")
    common = ws.put(places.groupBy("fp").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n")).where("c > 1").select("fp", (F.col("n") > max_windows).alias("hot")), "common")
    wanted = places.join(common.hint("merge"), "fp").groupBy(*key).agg(F.collect_set(F.struct("place", "n", "fp", "hot")).alias("places"))
    wanted = ws.put(wanted.join(copies.hint("merge"), key, "left"), "places")
    ws.drop(places, common)
    # texts meet one table with one row for each key, so that Spark can split the rows of a text with very many copies
    one = rows.join(wanted.hint("merge"), key).where("c is null or id <=> first_id")
    contexts = ws.put(_context_rows(one, length), "contexts")
    ws.drop(wanted)
    cold = contexts.where("not hot").select("fp", "id", "k1", "k2", "start", "context").repartition("fp").sortWithinPartitions("fp", "id", "k1", "k2", "start")
    marks = _shard(cold, length, keep)
    hot = contexts.where("hot")
    if not hot.isEmpty():
        marks = marks.unionByName(_counted(ws, hot, length, keep))
    marks = marks.groupBy(*key).agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    found = ws.put(copies.hint("merge").join(marks, key, "full"), "found")
    ws.drop(contexts, copies, wanted)
    whole = F.col("c").isNotNull() & (F.octet_length("x") >= length)
    if keep == "first":
        whole = whole & ~F.col("id").eqNullSafe(F.col("first_id"))
    return rows.join(found.hint("merge"), key, "left").select("id", *key, "x", F.coalesce(whole, F.lit(False)).alias("whole"), "spans")


def merged(spans: list[dict] | None, n: int, whole: bool) -> list[tuple[int, int]]:
    if whole:
        return [(0, n)]
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["start"], s["end"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start: long, end: long>>"
_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def dedup(docs: DataFrame, text: bool = True, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans of each row; with ``text`` also the kept bytes (a cut may fall inside a character)."""
    _runtime.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, x, whole, found in zip(*(batch.column(k) for k in range(4))):
                data = (x.as_buffer() or b"") and x.as_buffer().to_pybytes()
                cut = merged(found.as_py(), len(data), whole.as_py())
                keep, at = [], 0
                for a, b in cut:
                    keep.append(data[at:a])
                    at = b
                kept = b"".join([*keep, data[at:]])
                out.append((i.as_py(), len(data), len(data) - len(kept), len(cut), hashlib.sha256(kept).hexdigest(), kept if text else None, [{"start": a, "end": b} for a, b in cut]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(_OUT), _OUT.types)], schema=_OUT)

    return spans(docs, **options).select("id", "x", "whole", "spans").mapInArrow(run, OUT)
