"""ISO media containers: walk nested boxes, decode sample tables, never payloads.

``describe`` turns a binary column into codec, time scale, duration and keyframe byte ranges; ``mux`` writes payloads as 8-bit samples of
one ``raw `` track; ``read_samples`` cuts the stored bytes back out by the sample table.

Boxes are walked with a stack of their own, so depth is not bounded. Samples of movie fragments (``trun`` under its ``tfhd`` and the track's ``trex``) follow those of the
sample tables. All tracks are described; the first one with samples also stands in the row's own columns.

A null or empty file, or one whose boxes do not fit, has status ``empty`` or ``bad: reason`` and no tracks. Null ids pass through. Repeated rows give repeated results;
an empty table gives none; other columns are not read. Sizes above 4 GB use 64-bit box sizes and chunk offsets.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _runtime

NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"mvex", b"moof", b"traf", b"udta"}
UNIT, KEY_EVERY, PER_CHUNK, RATE = 64, 16, 1024, 8000


class BadMedia(ValueError):
    pass


@dataclass
class Track:
    codec: str = ""
    handler: str = ""
    number: int = 0
    timescale: int = 0
    duration: int = 0
    tables: dict = field(default_factory=dict)
    runs: list = field(default_factory=list)  # of fragments: (start, length, whether sync) of each sample
    lasted: int = 0  # by the fragments


@dataclass
class Fragment:
    """Where a track's fragment takes its bytes from, and what holds for samples that say nothing themselves."""

    track: Track | None = None
    at: int = 0
    duration: int = 0
    size: int = 0
    flags: int = 0


@dataclass
class Movie:
    tracks: list[Track] = field(default_factory=list)
    defaults: dict[int, tuple] = field(default_factory=dict)  # track number -> (duration, size, flags)
    moof: int = 0
    end: int = 0  # of the last run of samples
    fragment: Fragment = field(default_factory=Fragment)


def boxes(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int, int]]:
    """(type, start, payload start, payload end) of the boxes in data[at:end]."""
    while at < end:
        if end - at < 8:
            raise BadMedia("truncated box header")
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if end - at < 16:
                raise BadMedia("truncated box header")
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if kind == b"uuid":
            head += 16
        if size < head or at + size > end:
            raise BadMedia(f"box {kind!r} does not fit")
        yield kind, at, at + head, at + size
        at += size


def walk(data: bytes) -> list[Track]:
    """The tracks of a file, with their sample tables as arrays."""
    movie, open_ = Movie(), [boxes(data, 0, len(data))]
    while open_:
        box = next(open_[-1], None)
        if box is None:
            open_.pop()
            continue
        kind, at, a, b = box
        if kind == b"trak":
            movie.tracks.append(Track())
        elif kind == b"moof":
            movie.moof = movie.end = at
        elif kind == b"traf":
            movie.fragment = Fragment()
        try:
            if kind in NESTED:
                open_.append(boxes(data, a, b))
            elif kind in FRAGMENTS:
                FRAGMENTS[kind](movie, data, a, b)
            elif movie.tracks and kind in READ:
                READ[kind](movie.tracks[-1], data, a, b)
        except (struct.error, ValueError, IndexError) as e:
            raise BadMedia(f"{kind!r}: {e}") from None
    return movie.tracks


def _array(data: bytes, at: int, end: int, kind: str, n: int, width: int = 1) -> np.ndarray:
    size = np.dtype(kind).itemsize * n * width
    if at + size > end:
        raise BadMedia("a table does not fit its box")
    return np.frombuffer(data, kind, n * width, at).astype(np.int64).reshape(-1, width) if width > 1 else np.frombuffer(data, kind, n, at).astype(np.int64)


def _tkhd(t: Track, d: bytes, a: int, b: int) -> None:
    t.number = struct.unpack_from(">I", d, a + (20 if d[a] == 1 else 12))[0]


def _mdhd(t: Track, d: bytes, a: int, b: int) -> None:
    t.timescale, t.duration = struct.unpack_from(">IQ", d, a + 20) if d[a] == 1 else struct.unpack_from(">II", d, a + 12)


def _hdlr(t: Track, d: bytes, a: int, b: int) -> None:
    t.handler = d[a + 8 : a + 12].decode("latin-1")


def _stsd(t: Track, d: bytes, a: int, b: int) -> None:
    if struct.unpack_from(">I", d, a + 4)[0]:
        t.codec = d[a + 12 : a + 16].decode("latin-1")


def _stsz(t: Track, d: bytes, a: int, b: int) -> None:
    size, n = struct.unpack_from(">II", d, a + 4)
    t.tables["size"] = (size, n) if size else _array(d, a + 12, b, ">u4", n)


def _table(name: str, kind: str, width: int):
    def read(t: Track, d: bytes, a: int, b: int) -> None:
        t.tables[name] = _array(d, a + 8, b, kind, struct.unpack_from(">I", d, a + 4)[0], width)

    return read


def _trex(m: Movie, d: bytes, a: int, b: int) -> None:
    number, _, duration, size, flags = struct.unpack_from(">5I", d, a + 4)
    m.defaults[number] = duration, size, flags


def _tfhd(m: Movie, d: bytes, a: int, b: int) -> None:
    said, number = struct.unpack_from(">II", d, a)
    track = next((t for t in m.tracks if t.number == number), None)
    if track is None:
        raise BadMedia("a fragment of no track")
    f = m.fragment = Fragment(track, m.moof if said & 0x20000 else m.end, *m.defaults.get(number, (0, 0, 0)))
    at = a + 8
    for bit, form, name in ((0x1, ">Q", "at"), (0x2, ">I", None), (0x8, ">I", "duration"), (0x10, ">I", "size"), (0x20, ">I", "flags")):
        if said & bit:
            if name:
                setattr(f, name, struct.unpack_from(form, d, at)[0])
            at += struct.calcsize(form)
    m.end = f.at


def _trun(m: Movie, d: bytes, a: int, b: int) -> None:
    f = m.fragment
    if f.track is None:
        raise BadMedia("a run before its fragment's header")
    said, n = struct.unpack_from(">II", d, a)
    at, start, first = a + 8, m.end, None
    if said & 0x1:
        start = f.at + struct.unpack_from(">i", d, at)[0]
        at += 4
    if said & 0x4:
        first = struct.unpack_from(">I", d, at)[0]
        at += 4
    each = [name for bit, name in ((0x100, "duration"), (0x200, "size"), (0x400, "flags"), (0x800, "shift")) if said & bit]
    if n > len(d):
        raise BadMedia("more samples than the file has bytes")
    table = _array(d, at, b, ">u4", n, len(each)).reshape(n, len(each)) if each else np.zeros((n, 0), np.int64)
    of = {name: table[:, each.index(name)] if name in each else np.full(n, getattr(f, name), np.int64) for name in ("duration", "size", "flags")}
    if first is not None and n and "flags" not in each:
        of["flags"][0] = first
    end = start + np.cumsum(of["size"])
    if n:
        if start < 0 or end[-1] > len(d):
            raise BadMedia("a sample lies outside the file")
        m.end = int(end[-1])
        f.track.runs.append(np.stack([end - of["size"], of["size"], (of["flags"] >> 16 & 1) == 0], 1))
        f.track.lasted += int(of["duration"].sum())


FRAGMENTS = {b"trex": _trex, b"tfhd": _tfhd, b"trun": _trun}
READ = {b"tkhd": _tkhd, b"mdhd": _mdhd, b"hdlr": _hdlr, b"stsd": _stsd, b"stsz": _stsz, b"stts": _table("time", ">u4", 2), b"stsc": _table("chunk", ">u4", 3), b"stss": _table("sync", ">u4", 1), b"stco": _table("offset", ">u4", 1), b"co64": _table("offset", ">u8", 1)}


def sample_ranges(t: Track, file_size: int) -> np.ndarray:
    """(start, length) of every sample, from stsz, stsc and stco or co64."""
    size = t.tables.get("size", (0, 0))
    if isinstance(size, tuple) and size[0] * size[1] > file_size:
        raise BadMedia("more sample bytes than the file has")
    sizes = np.full(size[1], size[0], np.int64) if isinstance(size, tuple) else size
    offsets, runs = t.tables.get("offset", np.zeros(0, np.int64)), t.tables.get("chunk", np.zeros((0, 3), np.int64)).reshape(-1, 3)
    if not len(sizes):
        return np.zeros((0, 2), np.int64)
    if not len(offsets) or not len(runs):
        raise BadMedia("samples without chunks")
    until = np.append(runs[1:, 0], len(offsets) + 1)
    per = np.repeat(runs[:, 1], np.maximum(until - runs[:, 0], 0))[: len(offsets)]
    per = np.minimum(per, len(sizes))
    if per.sum() < len(sizes):
        raise BadMedia("fewer places than samples")
    chunk = np.repeat(np.arange(len(per)), per)[: len(sizes)]
    before = np.cumsum(sizes) - sizes
    new = np.append(True, chunk[1:] != chunk[:-1])
    start = offsets[chunk] + before - np.repeat(before[new], np.diff(np.append(np.flatnonzero(new), len(sizes))))
    if (start + sizes > file_size).any():
        raise BadMedia("a sample lies outside the file")
    return np.stack([start, sizes], 1)


def keyframes(t: Track, ranges: np.ndarray) -> np.ndarray:
    """Byte ranges of sync samples; without stss all samples are sync. Numbers outside the table are an error."""
    sync = t.tables.get("sync")
    if sync is None:
        return ranges
    if len(sync) and (sync.min() < 1 or sync.max() > len(ranges)):
        raise BadMedia("a sync sample has no place")
    return ranges[sync - 1]


def read_samples(data: bytes, ranges: np.ndarray) -> bytes:
    """The stored bytes in sample order; neighbours are cut out as one run."""
    if not len(ranges):
        return b""
    start, end = ranges[:, 0], ranges[:, 0] + ranges[:, 1]
    cut = np.flatnonzero(np.append(True, start[1:] != end[:-1]))
    return b"".join(data[start[a] : end[b - 1]] for a, b in zip(cut, np.append(cut[1:], len(ranges))))


def _box(kind: bytes, *parts: bytes) -> bytes:
    n = 8 + sum(map(len, parts))
    return (struct.pack(">I4s", n, kind) if n < 1 << 32 else struct.pack(">I4sQ", 1, kind, n + 8)) + b"".join(parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
_DINF = _box(b"dinf", _box(b"dref", struct.pack(">II", 0, 1), _box(b"url ", struct.pack(">I", 1))))
_FTYP = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")


def mux(payload: bytes, unit: int = UNIT, key_every: int = KEY_EVERY, per_chunk: int = PER_CHUNK, rate: int = RATE) -> bytes:
    """A file with one track of 8-bit mono samples, in access units of ``unit`` bytes; every ``key_every``-th unit is a sync sample."""
    n = len(payload) // unit
    assert n * unit == len(payload) and n
    n_chunks = -(-n // per_chunk)
    duration = len(payload)
    key = np.arange(1, n + 1, key_every, dtype=">u4")
    runs = [(1, per_chunk)] if n % per_chunk == 0 else [(1, n)] if n_chunks == 1 else [(1, per_chunk), (n_chunks, n % per_chunk)]
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, rate << 16))
    wide = len(payload) >= (1 << 32) - (1 << 26)
    long = struct.pack(">QQIQ", 0, 0, rate, duration), struct.pack(">QQIIQ", 0, 0, 1, 0, duration)
    short = struct.pack(">IIII", 0, 0, rate, duration & 0xFFFFFFFF), struct.pack(">IIIII", 0, 0, 1, 0, duration & 0xFFFFFFFF)
    times, track_times = long if duration >= 1 << 32 else short
    version = struct.pack(">I", (duration >= 1 << 32) << 24)

    def moov(first: int) -> bytes:
        offsets = first + np.arange(n_chunks, dtype=np.int64) * per_chunk * unit
        stbl = _box(
            b"stbl",
            _box(b"stsd", struct.pack(">II", 0, 1), entry),
            _box(b"stts", struct.pack(">IIII", 0, 1, n, unit)),
            _box(b"stss", struct.pack(">II", 0, len(key)), key.tobytes()),
            _box(b"stsc", struct.pack(">II", 0, len(runs)), *(struct.pack(">III", c, k, 1) for c, k in runs)),
            _box(b"stsz", struct.pack(">III", 0, unit, n)),
            _box(b"co64" if wide else b"stco", struct.pack(">II", 0, n_chunks), offsets.astype(">u8" if wide else ">u4").tobytes()),
        )
        minf = _box(b"minf", _box(b"smhd", bytes(8)), _DINF, stbl)
        mdia = _box(b"mdia", _box(b"mdhd", version, times, struct.pack(">HH", 0x55C4, 0)), _box(b"hdlr", bytes(8), b"soun", bytes(12), b"samples\0"), minf)
        tkhd = _box(b"tkhd", struct.pack(">I", (duration >= 1 << 32) << 24 | 7), track_times, bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), _MATRIX, bytes(8))
        mvhd = _box(b"mvhd", version, times, struct.pack(">IHH", 0x10000, 0x100, 0), bytes(8), _MATRIX, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    head = 16 if len(payload) + 8 >= 1 << 32 else 8
    size = len(moov(0))
    return b"".join([_FTYP, moov(len(_FTYP) + size + head), _box(b"mdat", payload)])


def _track(t: Track, file_size: int) -> dict:
    ranges = sample_ranges(t, file_size)
    keys = keyframes(t, ranges)
    if t.runs:
        runs = np.concatenate(t.runs).astype(np.int64)
        ranges, keys = np.concatenate([ranges, runs[:, :2]]), np.concatenate([keys, runs[runs[:, 2] == 1, :2]])
    return {"codec": t.codec, "handler": t.handler, "timescale": t.timescale, "duration": t.duration or t.lasted, "n_samples": len(ranges), "keyframes": keys, "ranges": ranges}


def features(data: bytes | None) -> dict:
    """What ``describe`` stores of one file."""
    none = {"codec": None, "handler": None, "timescale": None, "duration": None, "n_samples": 0, "keyframes": np.zeros((0, 2), np.int64), "ranges": np.zeros((0, 2), np.int64)}
    if not data:
        return none | {"status": "empty", "tracks": []}
    try:
        tracks = [_track(t, len(data)) for t in walk(data) if t.tables or t.runs]
        if not tracks:
            raise BadMedia("no track")
        return next((t for t in tracks if t["n_samples"]), tracks[0]) | {"status": "ok", "tracks": tracks}
    except BadMedia as e:
        return none | {"status": f"bad: {e}", "tracks": []}


_RANGES = "array<struct<start: long, length: long>>"
DESCRIBED = f"status string, codec string, timescale long, duration long, n_samples long, keyframes {_RANGES}, tracks array<struct<codec: string, handler: string, timescale: long, duration: long, n_samples: long, keyframes: {_RANGES}>>"
_KEYS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
_OF = [("codec", pa.string()), ("handler", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("n_samples", pa.int64()), ("keyframes", _KEYS)]
_OWN = [("status", pa.string()), *(c for c in _OF if c[0] != "handler"), ("tracks", pa.list_(pa.struct(_OF)))]


def describe(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """(id, status, codec, timescale, duration, n_samples, keyframes, tracks) of each row's file."""
    _runtime.ship(df.sparkSession)
    kind = dict(df.dtypes)[id_col]
    plain = lambda t: t | {"keyframes": [{"start": int(s), "length": int(n)} for s, n in t["keyframes"]]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [plain(f) | {"tracks": [plain(t) for t in f["tracks"]]} for f in (features(x.as_py()) for x in b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([g[k] for g in got], t) for k, t in _OWN)], ["id", *(k for k, _ in _OWN)])

    return df.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")).mapInArrow(run, f"id {kind}, {DESCRIBED}").withColumnRenamed("id", id_col)


STORED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each whole text, padded with zero bytes to a positive multiple of 64, stored as a media file, read back and described."""
    _runtime.ship(docs.sparkSession)
    hexed = lambda x: hashlib.sha256(x).hexdigest()

    def row(text: bytes) -> tuple:
        data = mux(text + bytes(UNIT - len(text) % UNIT if len(text) % UNIT or not text else 0))
        f = features(data)
        back = read_samples(data, f["ranges"])
        keys = f["keyframes"]
        feature = json.dumps({"codec": f["codec"], "duration": f["duration"], "timescale": f["timescale"], "samples": f["n_samples"], "keyframes": len(keys), "first": keys[0].tolist(), "last": keys[-1].tolist(), "ranges_crc32": zlib.crc32(keys.astype("<i8").tobytes())}, separators=(",", ":"))
        return len(text), len(back), hexed(back), zlib.crc32(back[-UNIT:]), len(data), hexed(data), feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = [c.split()[0] for c in STORED.split(", ")]
        for b in batches:
            rows = [row(x.as_py() or b"") for x in b.column(1)]
            cols = zip(*rows) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, STORED)
