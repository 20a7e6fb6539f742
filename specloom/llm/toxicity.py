"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of the words, beginnings and endings of words it holds; a document is toxic if any sentence is, so
sentence scores combine by noisy-or. Only document labels are used in training: the gradient of the document's likelihood reaches
the sentences through the noisy-or, and the trained sentence scores then locate the offending sentences.

The classifier is fitted on at most ``MAX_DOCS`` labelled documents and ``MAX_BYTES`` of their text, taken in the order of a hash of doc_id; the
fitted model is at most ``MAX_WORDS`` weights. Scoring reads every whole text and shuffles nothing.

Null and empty texts hold no sentence and get the score of a text without any known word: 0. Repeated rows get equal scores. Repeated labels of a doc_id count once,
toxic if any says so; null labels are not read. Without labels of both kinds the score is the share of toxic labels (0 without labels) everywhere.
Null doc_ids pass through. An empty table gives no rows; other columns are not read by ``score``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _runtime, _text

MAX_DOCS, MAX_BYTES, MAX_WORDS, BITS, Z = 8000, 24 << 20, 4096, 22, 3
_SEP = np.zeros(256, bool)
_SEP[[b for b in range(128) if not chr(b).isalnum()]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?\n")] = True


@dataclass
class Model:
    places: np.ndarray  # of the weights in a table of 2^BITS hashed features
    weights: np.ndarray
    bias: float
    constant: float | None = None

    def table(self) -> np.ndarray:
        t = np.zeros(1 << BITS, np.float32)
        t[self.places] = self.weights
        return t


def sentences(raw: np.ndarray, offs: np.ndarray) -> tuple[_text.Words, np.ndarray, np.ndarray]:
    """Words, the sentence of each word, and the first sentence of each text (n+1). A sentence without words is none."""
    w = _text.words(raw, offs, _SEP)
    if not len(w.start):
        return w, np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    stops = np.cumsum(_STOP[raw])[w.start]
    new = np.append(True, stops[1:] != stops[:-1])
    begins = w.first[:-1][np.diff(w.first) > 0]
    new[begins] = True
    of = np.cumsum(new) - 1
    first = np.where(w.first < len(of), of[np.minimum(w.first, len(of) - 1)], of[-1] + 1)
    return w, of, first


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def features(w: _text.Words) -> np.ndarray:
    """(7, words): hashed features of each word: itself, its first 4, 5 and 6 bytes, and its last 4, 5 and 6, where it is longer."""
    rows, size = [w.hash], w.end - w.start
    for k in (4, 5, 6):
        long = size > k
        rows.append(np.where(long, w.part(w.start, np.where(long, w.start + k, w.end), k), w.hash))
        rows.append(np.where(long, w.part(np.where(long, w.end - k, w.start), w.end, 16 + k), w.hash))
    return (np.stack(rows) >> np.uint64(64 - BITS)).astype(np.int64)


def _distinct(group: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(group << BITS | feature)
    return key >> BITS, key & ((1 << BITS) - 1)


def train(texts: list[str] | pa.Array, toxic: np.ndarray, max_words: int = MAX_WORDS, steps: int = 300, rate: float = 0.1, decay: float = 2e-4) -> Model:
    """Fits sentence weights to document labels by Adam on the noisy-or likelihood.

    A first pass counts each feature's documents by label and keeps those whose log odds are ``Z`` standard errors or more from 0; a second gathers the sentences that hold them.
    """
    y = np.asarray(toxic, np.float64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0, float(y.mean()) if len(y) else 0.0)
    column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    all_docs, pos = np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32)
    for a, b, raw, offs in _text.chunks(column, 1 << 19):
        w = _text.words(raw, offs, _SEP)
        if len(w.start):
            doc, f = _distinct(np.tile(np.repeat(np.arange(b - a), np.diff(w.first)), 7), features(w).ravel())
            np.add.at(all_docs, f, 1)
            np.add.at(pos, f, y[a + doc])
    seen = np.flatnonzero(all_docs >= 4)
    neg, pos, p, n = (all_docs - pos)[seen].astype(float), pos[seen].astype(float), y.sum(), len(y) - y.sum()
    odds = np.log((pos + 0.5) / (p - pos + 0.5)) - np.log((neg + 0.5) / (n - neg + 0.5))
    z = np.abs(odds) / np.sqrt(1 / (pos + 0.5) + 1 / (p - pos + 0.5) + 1 / (neg + 0.5) + 1 / (n - neg + 0.5))
    good = np.flatnonzero(z >= Z)
    good = np.sort(seen[good[np.argsort(-z[good], kind="stable")[:max_words]]])
    new = np.full(1 << BITS, -1, np.int32)
    new[good] = np.arange(len(good))
    sents, feats, doc_of, n_sent, at = [], [], [], [], 0
    for a, b, raw, offs in _text.chunks(column, 1 << 19):
        w, of, first = sentences(raw, offs)
        if len(of):
            f = new[features(w)]
            row, word = np.nonzero(f >= 0)
            s, f = _distinct(of[word], f[row, word].astype(np.int64))
            sents.append((s + at).astype(np.int32))
            feats.append(f.astype(np.int32))
        doc_of.append(np.repeat(np.arange(a, b), np.diff(first)))
        n_sent.append(np.diff(first))
        at += int(first[-1])
    s, f, d, n_sent = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (sents, feats, doc_of, n_sent))
    live, s = np.unique(s, return_inverse=True)
    d = d[live]
    bare = n_sent - np.bincount(d, minlength=len(y))  # sentences without any selected word
    theta = np.append(np.zeros(len(good)), np.log(y.mean() / max(n_sent.mean(), 1)))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        z = theta[-1] + np.bincount(s, weights=theta[f], minlength=len(live))
        total = np.bincount(d, weights=np.logaddexp(0, z), minlength=len(y)) + bare * np.logaddexp(0, theta[-1])
        total = np.maximum(total, 1e-9)
        outer = (1 - y) - y / np.expm1(np.minimum(total, 50))
        inner = outer[d] * _sigmoid(z)
        g = np.append(np.bincount(f, weights=inner[s], minlength=len(good)), inner.sum() + (outer * bare).sum() * _sigmoid(theta[-1])) / len(y)
        g[:-1] += decay * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Model(good, theta[:-1], float(theta[-1]))


def fold(id_col: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k; a null id counts as an empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % k


FITTED = "places array<long>, weights array<double>, bias double, constant double"
_FITTED = pa.schema([("places", pa.list_(pa.int64())), ("weights", pa.list_(pa.float64())), ("bias", pa.float64()), ("constant", pa.float64())])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES) -> Model:
    """A model of a bounded sample of labelled documents outside fold 0, trained in one task; the driver sees ids and sizes of the sample and the finished weights.

    Of rows with equal doc_id the shortest text is the document's, the first in byte order of equally long ones.
    """
    spark = docs.sparkSession
    _runtime.ship(spark)
    said = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y")).where(fold(F.col("id"), folds) != 0)
    sized = docs.select(F.col(id_col).alias("id"), F.octet_length(F.coalesce(text_col, F.lit(""))).alias("n")).join(said, "id").groupBy("id", "y").agg(F.min("n").alias("n"))
    taken, room = [], max_bytes
    for r in sized.orderBy(F.xxhash64("id"), "id").limit(max_docs).collect():
        if r.n <= room:
            taken.append((r.id, r.n, r.y))
            room -= r.n
    if not taken:
        return train([], np.zeros(0))
    # By id, not by a join of large tables: Spark then reads the chosen rows in one narrow pass.
    ids = F.broadcast(spark.createDataFrame(taken, "id long, n int, y int"))
    chosen = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("x")).withColumn("n", F.octet_length("x")).join(ids, ["id", "n"]).groupBy("id", "y").agg(F.min("x").alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if held:
            t = pa.Table.from_batches(held).sort_by("id").combine_chunks()
            m = train(t.column(2).combine_chunks(), t.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array([m.places.tolist()], _FITTED.types[0]), pa.array([m.weights.tolist()], _FITTED.types[1]), pa.array([m.bias]), pa.array([m.constant], pa.float64())], schema=_FITTED)

    (m,) = chosen.select("id", "y", "x").coalesce(1).mapInArrow(run, FITTED).collect()
    return Model(np.array(m.places, np.int64), np.array(m.weights, float), m.bias, m.constant)


OUT = "score double, worst_start long, worst_end long, worst_score double"


def score_chunk(model: Model, table: np.ndarray, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Score of each text; byte range and score of its most toxic sentence (-1 without any)."""
    n = len(offs) - 1
    if model.constant is not None:
        return np.full(n, model.constant), np.full(n, -1), np.full(n, -1), np.zeros(n)
    w, of, first = sentences(raw, offs)
    total, start, end, worst = np.zeros(n), np.full(n, -1), np.full(n, -1), np.zeros(n)
    if not len(of):
        return total, start, end, worst
    place = features(w)
    weight = table[place]
    row, word = np.nonzero(weight)
    # a feature counts once in a sentence
    _, once = np.unique(of[word] << BITS | place[row, word], return_index=True) if len(word) else (None, np.zeros(0, np.int64))
    z = model.bias + np.bincount(of[word[once]], weights=weight[row[once], word[once]], minlength=int(first[-1]))
    soft = np.logaddexp(0, z)
    total = -np.expm1(-_text.reduce_sum(soft, first))
    full = np.flatnonzero(np.diff(first) > 0)
    doc = np.repeat(np.arange(n), np.diff(first))
    order = np.lexsort((np.arange(len(z)), -z, doc))
    best = order[first[full]]
    begins = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    ends = np.append(begins[1:], len(of)) - 1
    start[full] = w.start[begins[best]] - offs[full]
    end[full] = w.end[ends[best]] - offs[full]
    worst[full] = _sigmoid(z[best])
    return np.clip(total, 0, 1), start, end, worst


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, the text's score and where its most toxic sentence lies."""
    _runtime.ship(docs.sparkSession)
    types = dict(docs.dtypes)
    names = [*keep, "score", "worst_start", "worst_end", "worst_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for batch in batches:
            got = [score_chunk(model, table, raw, offs) for _, _, raw, offs in _text.chunks(batch.column(0), 1 << 19)]
            cols = [np.concatenate(x) for x in zip(*got)] if got else [np.zeros(0)] * 4
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(c, t) for c, t in zip(cols, (pa.float64(), pa.int64(), pa.int64(), pa.float64())))], names)

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), OUT])
    return docs.select(F.col(text_col).alias("__x"), *keep).mapInArrow(run, schema)


def drop(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all columns, whose score is below ``threshold``; rows with null or empty texts stay, repeated rows stay or go together."""
    _runtime.ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for batch in batches:
            got = [score_chunk(model, table, raw, offs)[0] for _, _, raw, offs in _text.chunks(batch.column(at), 1 << 19)]
            yield batch.filter(pa.array(np.concatenate(got) < threshold)) if got else batch

    return docs.mapInArrow(run, docs.schema)
