"""MinHash near-duplicates with tensored banding.

A text's set holds its distinct runs of five words. Two collections of ``M`` half keys are made, each half key from two minhashes; a table's key is
one half key of each collection, so M * M tables of four minhashes cost 4 * M minhashes instead of 4 * M * M. A half key that no other set shares
can be in no shared table key, so half keys are counted first and table keys are formed only from shared ones. At similarity 0.75 a
pair is in no common table with a probability of 2 * (1 - 0.75^2)^M: 0.0005 for M = 10; above 0.8 it is under 0.0001.

Sets that are equal are one node. In every table bucket each node is first verified against the bucket's smallest node, and components are taken
over the links found. Only buckets that still hold several components go on: nodes that such buckets connect form a family, whose nodes are dealt to
blocks; each pair of blocks that holds several components is one group of rows, which compares sketches and verifies at once, on full sets, the pairs that share a table key and
agree in enough minhashes. So a bucket never becomes all its pairs in rows, no task gets a whole large family, and no pair is left out.
Verification counts full sets, 100 * both >= 75 * either: by hashes, and what passes once more by the words themselves.

Null and empty texts, and those without words, have an empty set and no links. With fewer than five words the whole sequence is the one element. Null
doc_ids are linked with nothing. Rows with equal doc_id are one document: each row is judged by its own text, and what any of them is linked with is linked
with all. Other columns are not read by ``classes`` and pass through ``dedup`` whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _runtime, _text
from .components import components
from .lines import fresh

M, PERCENT, BLOCK, BLOCK_BYTES = 10, 75, 1024, 8 << 20
#: Of the 4 * M minhashes, as many must agree before a pair of a mixed bucket is verified; at similarity 0.75 fewer do with a probability of about 0.00001.
AGREE = 18
_rng = np.random.Generator(np.random.PCG64(7))
_A = _rng.integers(1, 1 << 63, 4 * M, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(1, 1 << 63, 4 * M, dtype=np.uint64)
_SIGNED = pa.schema([("id", pa.int64()), ("k", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("halves", pa.list_(pa.int64()))])


def sets(raw: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    s, first = _text.shingles(_text.words(raw, offs))
    return [np.unique(s[a:b]) for a, b in zip(first[:-1], first[1:])]


def minhashes(s: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.stack([_text.reduce_min(s * a + b, first, 0) for a, b in zip(_A, _B)], 1)


def half_keys(mins: np.ndarray) -> np.ndarray:
    """2 * M keys: collection 0, then collection 1; the number of the key is hashed in."""
    slot = np.arange(2 * M, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return _text.mix(_text.mix(mins[:, 0::2] + slot) + mins[:, 1::2])


def sign(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, k, n, d1, d2, halves): size and digest of each row's set, and its half keys; k is a hash of the text."""
    _runtime.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, offs in _text.chunks(batch.column(2)):
                s, first = _text.shingles(_text.words(raw, offs))
                unique = [np.unique(s[x:y]) for x, y in zip(first[:-1], first[1:])]
                n = np.array([len(u) for u in unique])
                flat, at = np.concatenate(unique), np.concatenate([[0], np.cumsum(n)])
                d1, d2 = (_text.reduce_sum(_text.mix(flat ^ np.uint64(c)), at).view(np.int64) for c in (0x1234567, 0x89ABCDEF01))
                mins = minhashes(flat, at)
                halves = half_keys(mins).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * (2 * M)), pa.array(halves.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(n), pa.array(d1), pa.array(d2), lists], schema=_SIGNED)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("k"), F.col(text_col).alias("x")).mapInArrow(run, "id long, k long, n long, d1 long, d2 long, halves array<long>")


def alike(x: bytes, y: bytes, percent: int = PERCENT) -> bool:
    """Whether the full sets of two texts, of words as they are, are similar enough."""
    a, b = x.lower().split(), y.lower().split()  # bytes: A-Z, and exactly the six separators
    if a == b:
        return bool(a)
    s, t = (set(zip(*(w[k:] for k in range(_text.SHINGLE)))) if len(w) >= _text.SHINGLE else {tuple(w)} if w else set() for w in (a, b))
    both = len(s & t)
    return bool(s and t) and 100 * both >= percent * (len(s) + len(t) - both)


def verify(pairs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of (a, b, xa, xb), the pairs (a, b) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                left, right = ([u for _, _, raw, offs in _text.chunks(part.column(k)) for u in sets(raw, offs)] for k in (2, 3))
                ok = []
                for k, (x, y) in enumerate(zip(left, right)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    near = bool(len(x) and len(y)) and 100 * both >= percent * (len(x) + len(y) - both)
                    ok.append(near and alike(*(part.column(c)[k].as_buffer().to_pybytes() for c in (2, 3)), percent))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.select("a", "b", "xa", "xb").mapInArrow(run, "a long, b long")


def compare_blocks(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between the two blocks of each (family, i, j). Rows, sorted by family, i and j: family, i, j, side, node, component, x.

    Pairs that share a table key, whose sketches agree and whose nodes are in different components are verified on full sets; a link found
    joins components at once, so that a block gives fewer links than it has nodes.
    """

    def links(side: np.ndarray, node: np.ndarray, comp: np.ndarray, texts: pa.Array, same: bool) -> list[tuple[int, int]]:
        shingles = [u for _, _, raw, offs in _text.chunks(texts) for u in sets(raw, offs)]
        n = np.array([len(u) for u in shingles])
        flat, first = np.concatenate(shingles), np.concatenate([[0], np.cumsum(n)])
        mins = minhashes(flat, first)
        sketch = (mins >> np.uint64(32)).astype(np.uint32)
        right = np.flatnonzero(side == (0 if same else 1))
        found = []
        for k in np.flatnonzero(side == 0):
            to = right[right > k] if same else right
            to = to[(comp[to] != comp[k]) & (100 * np.minimum(n[to], n[k]) >= percent * np.maximum(n[to], n[k]))]
            to = to[(sketch[to] == sketch[k]).sum(1) >= AGREE]
            if not len(to):
                continue
            half = (mins[to, 0::2] == mins[k, 0::2]) & (mins[to, 1::2] == mins[k, 1::2])
            to = to[half[:, :M].any(1) & half[:, M:].any(1)]
            if not len(to):
                continue
            elements = np.concatenate([shingles[t] for t in to])
            at = np.minimum(np.searchsorted(shingles[k], elements), n[k] - 1)
            both = _text.reduce_sum((shingles[k][at] == elements).astype(np.int64), np.concatenate([[0], np.cumsum(n[to])]))
            for t in to[100 * both >= percent * (n[to] + n[k] - both)]:
                if comp[t] != comp[k] and alike(*(texts[int(i)].as_buffer().to_pybytes() for i in (k, t)), percent):
                    found.append((int(node[k]), int(node[t])))
                    comp[comp == comp[t]] = comp[k]
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def flush(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            family, i, j, side, node, comp = (t.column(k).to_numpy() for k in range(6))
            cut = np.flatnonzero(np.append(True, (family[1:] != family[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
            texts = t.column(6).combine_chunks()
            got = [x for a, b in zip(cut, np.append(cut[1:], len(family))) for x in links(side[a:b], node[a:b], comp[a:b].copy(), texts.slice(a, b - a), i[a] == j[a])]
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.int64())], ["a", "b"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([held, t]) if held is not None else t
            family, i, j = (t.column(k).to_numpy() for k in range(3))
            last = (family == family[-1]) & (i == i[-1]) & (j == j[-1])
            n = len(family) - int(last[::-1].argmin()) if not last.all() else 0
            held = t.slice(n)
            if n:
                yield flush(t.slice(0, n))
        if held is not None and len(held):
            yield flush(held)

    return rows.select("family", "i", "j", "side", "node", "component", "x").mapInArrow(run, "a long, b long")


def deal(ws: _runtime.Workspace, told: DataFrame) -> DataFrame:
    """Rows (family, i, j, side, node, component, x): the members of families, once for each pair of blocks in which they meet nodes of other components.

    A component of BLOCK nodes or BLOCK_BYTES has blocks of its own, which do not meet each other; smaller ones share blocks. So a few strays beside a very large
    component cost one copy of its texts for each block of strays.
    """
    whole = told.groupBy("family").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("family")
    sizes = told.groupBy("family", "component").agg(F.count(F.lit(1)).alias("c"), F.sum(F.octet_length("x")).alias("size"))
    blocks_of = F.greatest(F.ceil(F.col("c") / BLOCK), F.ceil(F.col("size") / BLOCK_BYTES), F.lit(1)).cast("int")
    sizes = ws.put(sizes.join(whole.hint("merge"), "family", "left_semi").withColumn("own", (F.col("c") >= BLOCK) | (F.col("size") >= BLOCK_BYTES)), "component-sizes")
    shared = sizes.where("not own").groupBy("family").agg(F.sum("c").alias("c"), F.sum("size").alias("size")).select("family", F.lit(False).alias("own"), F.lit(0).cast("long").alias("of"), blocks_of.alias("n"))
    runs = ws.put(sizes.where("own").select("family", "own", F.col("component").alias("of"), blocks_of.alias("n")).unionByName(shared), "runs")
    each = runs.select("family", "own", "of", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("r"))
    block = ws.put(each.withColumn("i", F.row_number().over(W.partitionBy("family").orderBy("own", "of", "r"))), "blocks")
    left, right = block.select("family", "own", "of", "i"), block.select("family", F.col("own").alias("own_"), F.col("of").alias("of_"), F.col("i").alias("j"))
    pairs = ws.put(left.join(right.hint("merge"), "family").where("i <= j and not (own and own_ and of = of_)").select("family", "i", "j"), "block-pairs")
    of = F.when(F.col("own"), F.col("component")).otherwise(F.lit(0).cast("long"))
    placed = told.join(sizes.select("family", "component", "own").hint("merge"), ["family", "component"]).withColumn("of", of).join(runs.hint("merge"), ["family", "own", "of"])
    placed = placed.withColumn("r", F.pmod(F.xxhash64("node"), F.col("n")).cast("int")).join(block.select("family", "own", "of", "r", F.col("i").alias("at")).hint("merge"), ["family", "own", "of", "r"])
    placed = ws.put(placed.select("family", "at", "node", "component", "x"), "dealt")
    meet = lambda at, side, where: placed.join(pairs.where(where).withColumn("at", F.col(at)).hint("merge"), ["family", "at"]).select("family", "i", "j", F.lit(side).alias("side"), "node", "component", "x")
    return meet("i", 0, "true").unionByName(meet("j", 1, "i < j"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable), kept (whether that is the row's own)."""
    spark = docs.sparkSession
    ws = _runtime.Workspace(spark, "neardup")
    signed = ws.put(sign(docs, id_col, text_col), "signed")
    digest = ["d1", "d2", "n"]
    reps = ws.put(signed.where("n > 0 and id is not null").groupBy(*digest).agg(F.min("id").alias("rep")), "reps")
    # a node is a set; its number is the smallest doc_id that has it, or a hash where that document has several sets
    nth = F.row_number().over(W.partitionBy("rep").orderBy(*digest))
    sets_of = signed.where("n > 0").join(reps.hint("merge"), digest).where("id = rep").dropDuplicates(["rep", *digest]).withColumn("node", F.when(nth == 1, F.col("rep")).otherwise(F.xxhash64("rep", *digest)))
    nodes = ws.put(sets_of.select("node", "rep", "k", "halves"), "nodes")
    exploded = nodes.select("node", F.posexplode("halves").alias("slot", "half"))
    shared = ws.put(exploded.groupBy("half").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("half"), "shared")
    side = lambda first: F.collect_list(F.when((F.col("slot") < M) == F.lit(first), F.col("half")))
    halves = exploded.join(shared.hint("merge"), "half").groupBy("node").agg(side(True).alias("l"), side(False).alias("r"))
    keys = F.flatten(F.transform("l", lambda x: F.transform(F.col("r"), lambda y: F.xxhash64(x, y))))
    tables = ws.put(halves.select("node", F.explode(keys).alias("key")), "tables")
    buckets = ws.put(tables.groupBy("key").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("c")).where("c > 1"), "buckets")
    stars = ws.put(tables.join(buckets.hint("merge"), "key").where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct(), "stars")
    ws.drop(shared, buckets)

    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.xxhash64(F.col(text_col)).alias("k"), F.col(text_col).alias("x")).where("rep is not null")

    def texts_of(wanted: DataFrame, name: str) -> DataFrame:
        """(node, x): one text of each node of ``wanted``, from the input."""
        at = ws.put(nodes.select("node", "rep", "k").join(wanted.hint("merge"), "node", "left_semi"), f"{name}-places")
        return ws.put(texts.join(at.hint("merge"), ["rep", "k"]).groupBy("rep", "k", "node").agg(F.first("x").alias("x")).select("node", "x"), f"{name}-texts")

    def linked(pairs: DataFrame, name: str) -> DataFrame:
        """Verified pairs."""
        one = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), name)
        left = one.select(F.col("node").alias("a"), F.col("x").alias("xa"))
        right = one.select(F.col("node").alias("b"), F.col("x").alias("xb"))
        out = ws.put(verify(pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")).distinct(), f"{name}-links")
        ws.drop(one)
        return out

    # the sets of one document are linked
    several = signed.where("n > 0 and id is not null").groupBy("id").agg(F.min("d1").alias("lo"), F.max("d1").alias("hi")).where("lo <> hi").select("id")
    own = signed.where("n > 0").join(several.hint("merge"), "id", "left_semi").join(reps.hint("merge"), digest).select(F.col("id").alias("a"), F.col("rep").alias("b"))
    own = ws.put(own.union(nodes.where("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))).distinct(), "own-links")

    verified = linked(stars, "star")
    links = verified.union(own)
    ws.drop(stars)
    comp = ws.put(components(ws, links), "star-components")
    member = ws.put(tables.join(comp.hint("merge"), "node", "left").select("key", "node", F.coalesce("component", "node").alias("component")), "members")
    mixed = ws.put(member.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("node").alias("centre"), F.count(F.lit(1)).alias("c")).where("lo <> hi and c > 2").select("key", "centre"), "mixed")
    near = ws.put(member.join(mixed.hint("merge"), "key").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct(), "near")
    ws.drop(tables, member, mixed)
    if not near.isEmpty():
        family = ws.put(components(ws, near), "families").withColumnRenamed("component", "family")
        placed = ws.put(family.join(comp.hint("merge"), "node", "left").select("node", "family", F.coalesce("component", "node").alias("component")), "placed")
        told = ws.put(texts_of(placed.select("node"), "family").join(placed.hint("merge"), "node"), "family-members")
        dealt = deal(ws, told)
        more = ws.put(compare_blocks(dealt.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "side", "node")).distinct(), "block-links")
        ws.drop(told, placed)
        if not more.isEmpty():
            comp = ws.put(components(ws, links.union(more)), "components")
        ws.drop(more)
    ws.drop(near, verified, own, nodes)
    out = signed.select("id", "n", "d1", "d2").join(reps.hint("merge"), digest, "left")
    out = out.withColumn("rep", F.when(F.col("id").isNotNull(), F.col("rep")))
    out = out.join(comp.hint("merge"), out["rep"] == comp["node"], "left")
    component = F.coalesce(F.col("component"), F.col("rep"), F.col("id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept: one document of each component."""
    key, ws = fresh(docs, "kept_id"), _runtime.Workspace(docs.sparkSession, "neardup")
    gone = ws.put(classes(docs, id_col, text_col).where("not kept").select(F.col("doc_id").alias(key)).distinct(), "gone")
    return docs.join(_runtime.beside(gone, gone.count() * 16), F.col(id_col).cast("long") == gone[key], "left_anti")
