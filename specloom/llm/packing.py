"""Hierarchical multi-length packing.

Every document becomes its token ids and one end id. Whole windows of the longest tier are cut off first; what is left is routed to
the smallest tier that holds it. Tiers are packed from the longest: a window starts with one of its own pieces, and its gap
is filled from shorter tiers, whole pieces first and then one cut piece. When shorter tiers run dry, a window takes the
beginning of another piece of its own tier. All tier sizes are powers of two; what remains at a partition's end
is cut into powers of two, so no sequence needs padding. Sequences join step groups of equal token totals.

Packing runs in each partition as a stream: only ``pool_tokens`` tokens wait at a time, nothing is shuffled, and a retried task
yields the same sequences. Sequence ids carry the partition's number in their upper bits.

Null and empty texts are one end id. Very long texts are cut into full windows. Repeated rows and ties are packed each by itself, in input order.
Null doc_ids pass through. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _runtime

TIERS = (128, 256, 512, 1024)
SPACES = 50_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
_loaded: dict[str, tuple] = {}


def encoder(tokenizer: str):
    """text -> ids of the ``tokenizers`` file, as encode(text, add_special_tokens=False).

    Where a rank file of the same vocabulary lies beside it, texts take that faster way: the ids are the same (tested over two whole tables and every letter below U+20000).
    Texts that hold a special token's string, or more than ``SPACES`` separators in a row, which the faster way cannot hold on its stack, are encoded by ``tokenizers`` itself.
    """
    if tokenizer in _loaded:
        return _loaded[tokenizer]
    import base64
    import os

    from tokenizers import Tokenizer

    full = Tokenizer.from_file(tokenizer)
    plain = lambda text: full.encode(text, add_special_tokens=False).ids
    ranks = tokenizer.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks):
        _loaded[tokenizer] = plain
        return plain
    import tiktoken
    from public_tokenizers import PATTERN

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    quick = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    special = [str(t) for t in full.get_added_tokens_decoder().values()] if hasattr(full, "get_added_tokens_decoder") else ["<|endoftext|>"]
    gap = re.compile(rf"\s{{{SPACES}}}")

    def encode(text: str) -> list[int]:
        return plain(text) if any(s in text for s in special) or len(text) >= SPACES and gap.search(text) else quick.encode_ordinary(text)

    _loaded[tokenizer] = encode
    return encode


class Packer:
    """Packs pieces (doc_id, start, ids, doc_tokens) of one partition; ``rows`` collects the output."""

    def __init__(self, base: int, tiers: tuple[int, ...], group_tokens: int) -> None:
        self.tiers, self.top, self.base, self.group_tokens = sorted(tiers), max(tiers), base, group_tokens
        self.wait = {t: deque() for t in self.tiers}
        self.waiting = self.n_seq = self.n_group = self.ready_tokens = 0
        self.ready: dict[int, deque] = {}
        self.done: list[tuple[int, list]] = []
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        n, at = len(ids), 0
        while n - at > self.top:
            self.done.append((self.top, [(doc_id, at, ids[at : at + self.top], n)]))
            at += self.top
        self.route((doc_id, at, ids[at:], n))

    def route(self, piece: tuple) -> None:
        size = len(piece[2])
        self.wait[next(t for t in self.tiers if t >= size)].append(piece)
        self.waiting += size

    def take(self, tier: int, room: int):
        """A piece of ``tier`` for at most ``room`` tokens; the rest of a longer one goes back."""
        q = self.wait[tier]
        doc_id, at, ids, n = q.popleft()
        self.waiting -= len(ids)
        if len(ids) > room:
            self.route((doc_id, at + room, ids[room:], n))
            ids = ids[:room]
        return doc_id, at, ids, n

    def pack(self, last: bool) -> None:
        """Packs the longer tiers first; keeps less than a window unless it is the last call."""
        for k in range(len(self.tiers) - 1, -1, -1):
            tier = self.tiers[k]
            while self.wait[tier] and self.waiting >= tier:
                parts, room = [], tier
                while room:
                    below = [t for t in self.tiers[: k + 1] if self.wait[t]]
                    if not parts:
                        source = tier
                    else:
                        whole = [t for t in below if t < tier and len(self.wait[t][0][2]) <= room]
                        shorter = [t for t in below if t < tier]
                        source = whole[-1] if whole else shorter[-1] if shorter else tier if self.wait[tier] else 0
                    if not source:
                        break
                    parts.append(self.take(source, room))
                    room -= len(parts[-1][2])
                if room:  # only longer pieces wait elsewhere
                    for p in parts:
                        self.route(p)
                    break
                self.done.append((tier, parts))
        if last:
            rest = [p for t in reversed(self.tiers) for p in self.wait[t]]
            total = sum(len(p[2]) for p in rest)
            parts, size, room = [], 0, 0
            for doc_id, at, ids, n in rest:
                while len(ids):
                    if not room:
                        size = room = min(self.top, 1 << (total.bit_length() - 1))
                    cut = ids[:room]
                    parts.append((doc_id, at, cut, n))
                    at, ids = at + len(cut), ids[len(cut) :]
                    room -= len(cut)
                    total -= len(cut)
                    if not room:
                        self.done.append((size, parts))
                        parts = []
            for q in self.wait.values():
                q.clear()
            self.waiting = 0
        self.flush(last)

    def flush(self, last: bool) -> None:
        """Whole step groups of the packed sequences, the largest first: powers of two fill a group to the last token."""
        for size, parts in self.done:
            self.ready.setdefault(size, deque()).append(parts)
            self.ready_tokens += size
        self.done = []
        while self.ready_tokens >= self.group_tokens or last and self.ready_tokens:
            room = self.group_tokens
            for size in sorted(self.ready, reverse=True):
                while self.ready[size] and size <= room:
                    self.emit(size, self.ready[size].popleft())
                    room -= size
            self.ready_tokens -= self.group_tokens - room
            self.n_group += 1

    def emit(self, size: int, parts: list) -> None:
        offset = 0
        for doc_id, at, ids, n in parts:
            self.rows.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes()), n, self.base + self.n_seq, offset, size, self.base + self.n_group))
            offset += len(ids)
        self.n_seq += 1


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = TIERS, end_id: int = 0, pool_tokens: int = 1 << 20, group_sequences: int = 16) -> DataFrame:
    """One row for each piece of each document; see the module for the method and for odd rows."""
    _runtime.ship(docs.sparkSession)
    assert all(t & (t - 1) == 0 for t in tiers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        packer = Packer(TaskContext.get().partitionId() << 33, tiers, group_sequences * max(tiers))

        def out():
            cols = list(zip(*packer.rows)) or [[]] * len(OUT)
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, OUT.types)], schema=OUT)

        for batch in batches:
            ids_of, texts = batch.column(0), batch.column(1)
            for i in range(len(batch)):
                ids = np.array([*encode(texts[i].as_py() or ""), end_id], dtype="<u4")
                packer.add(ids_of[i].as_py(), ids)
                if packer.waiting >= pool_tokens or len(packer.done) >= 4096:
                    packer.pack(False)
                    yield out()
        packer.pack(True)
        yield out()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()), ("step_group", pa.int64())])
