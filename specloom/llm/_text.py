"""Vectorised words and hashes over Arrow batches of texts.

A word is ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. All separators are ASCII, so words are cut on UTF-8 bytes.
A word's hash starts from its length and takes in eight bytes at a time, each followed by a bijective mix; words above ``LONG`` bytes are
hashed by BLAKE2. So no family of words collides by its structure; two different words have equal hashes with a probability of 2^-64.
Everything works on chunks of a few MB, so memory does not follow the batch or the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK = 1 << 21
SHINGLE = 5

LONG = 256
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = _LOWER[97:123]
_SEP = np.zeros(256, bool)
_SEP[[32, 9, 10, 11, 12, 13]] = True
_BASE = U64(0x9E3779B97F4A7C15)
_STEP = U64(0xD6E8FEB86659FD93)
_SEED = U64(0x2545F4914F6CDD1D)
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)  # masks of the first k bytes


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and n+1 offsets into them. A null is empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offs


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows with about ``size`` bytes; a longer text is a run of its own."""
    raw, offs = buffers(column)
    n, a = len(offs) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + size, "right")) - 1)
        b = min(b, n)
        yield a, b, raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes that begin at each place, as one number; beyond the end lie zeros."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    return np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))


@dataclass
class Words:
    start: np.ndarray  # byte offsets in the chunk
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # n+1: where each text's words begin
    wide: np.ndarray | None = None  # eights of the lower-cased bytes

    def part(self, start: np.ndarray, end: np.ndarray, salt: int) -> np.ndarray:
        """Hashes of the byte ranges start:end, of at most eight bytes, apart from those of words and of other salts."""
        return mix(mix(self.wide[start] & _FIRST[end - start]) + U64(salt * int(_BASE) & 0xFFFFFFFFFFFFFFFF))


def ranges(raw: np.ndarray, wide: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges start:end."""
    size = end - start
    h = mix(size.astype(U64) * _STEP + _SEED)
    live, k = np.arange(len(start)), 0
    long = np.flatnonzero(size > LONG)
    if len(long):
        live = np.flatnonzero(size <= LONG)
    while len(live):
        live = live[size[live] > k]
        at, left = start[live] + k, size[live] - k
        block = wide[at]
        short = left < 8
        block[short] &= _FIRST[left[short]]
        h[live] = mix(h[live] ^ block)
        k += 8
    for i in long:
        h[i] = int.from_bytes(hashlib.blake2b(raw[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def words(raw: np.ndarray, offs: np.ndarray, separators: np.ndarray = _SEP) -> Words:
    n = len(raw)
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(z, z, np.zeros(0, U64), np.zeros(len(offs), np.int64))
    sep = separators[raw]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    word = ~sep
    begin = word.copy()
    begin[1:] &= sep[:-1] | edge[1:n]
    stop = word
    stop[:-1] &= sep[1:] | edge[1:n]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    low = _LOWER[raw]
    wide = eights(low)
    return Words(start, end, ranges(low, wide, start, end), np.searchsorted(start, offs), wide)


def shingles(w: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of k words, with n+1 offsets; a text of 1 to k-1 words has one, of all its words."""
    counts = np.diff(w.first)
    per = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(per)])
    if first[-1] == 0:
        return np.zeros(0, U64), first
    m = len(w.hash)
    if m >= k:
        s = w.hash[: m - k + 1].copy()
        for j in range(1, k):
            s *= _BASE
            s += w.hash[j : m - k + 1 + j]
    else:
        s = np.zeros(0, U64)
    long = counts >= k
    if long.all():
        at = np.arange(first[-1]) + np.repeat(w.first[:-1] - first[:-1], per)
        return mix(s[at]), first
    out = np.empty(first[-1], U64)
    pl = np.where(long, per, 0)
    tot = int(pl.sum())
    if tot:
        src = np.arange(tot) - np.repeat(np.cumsum(pl) - pl, pl) + np.repeat(w.first[:-1], pl)
        dst = np.arange(tot) - np.repeat(np.cumsum(pl) - pl, pl) + np.repeat(first[:-1], pl)
        out[dst] = mix(s[src])
    for i in np.flatnonzero((counts > 0) & ~long):
        x = U64(int(counts[i]))
        with np.errstate(over="ignore"):
            for h in w.hash[w.first[i] : w.first[i + 1]]:
                x = U64((int(x) * int(_STEP) + int(h)) & 0xFFFFFFFFFFFFFFFF)
        out[first[i]] = mix(np.array([x], U64))[0]
    return out, first


def reduce_min(values: np.ndarray, first: np.ndarray, empty: int) -> np.ndarray:
    """Minimum of values[first[i]:first[i+1]]; ``empty`` for empty ranges."""
    out = np.full(len(first) - 1, empty, values.dtype)
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        out[full] = np.minimum.reduceat(values, first[:-1][full])
    return out


def reduce_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.zeros(len(first) - 1, values.dtype)
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, first[:-1][full])
    return out
