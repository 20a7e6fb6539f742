"""Connected components of an edge table: local contraction, then alternating large and small stars.

The edges are dealt to parts of at most ``PART`` edges, and each part is replaced by the stars of its own components, smallest node in the middle. If one part holds all
edges, these are the components. Else stars are alternated between rounds: each step is a pre-aggregated minimum and a join to a stored table of minima, so a node with very many edges
is split by Spark like any skewed join. Every round is written to the shared folder; nothing is collected. Ends when a round changes no edge.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import Workspace

PART = 1_000_000


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for all nodes but the smallest."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(ids))
    while True:
        new, least = label.copy(), np.minimum(label[a], label[b])
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    some = np.flatnonzero(label != np.arange(len(ids)))
    return ids[some], ids[label[some]]


def _contracted(edges: DataFrame, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            t = pa.Table.from_batches(held)
            u, v = stars(t.column(0).to_numpy(), t.column(1).to_numpy())
            for k in range(0, len(u), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(u[k : k + (1 << 16)]), pa.array(v[k : k + (1 << 16)])], ["u", "v"])

    return (edges.coalesce(1) if parts == 1 else edges.repartition(parts)).mapInArrow(run, "u long, v long")


def _stamp(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(ws: Workspace, edges: DataFrame, max_rounds: int = 50, part: int = PART) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``edges`` (columns a and b, long, no nulls)."""
    e = ws.put(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    stamp = _stamp(e)
    for _ in range(max_rounds if stamp[0] else 0):
        parts = -(-stamp[0] // part)
        near = ws.put(_contracted(e, parts), "contracted")
        ws.drop(e)
        if parts == 1:
            e = near
            break
        both = near.union(near.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = ws.put(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "large")
        big = ws.put(both.join(low.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        ws.drop(near, low)
        low = ws.put(big.groupBy("u").agg(F.min("v").alias("m")), "small")
        linked = big.join(low.hint("merge"), "u")
        e = ws.put(linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        ws.drop(big, low)
        was, stamp = stamp, _stamp(e)
        if was == stamp:
            break
    else:
        if stamp[0]:
            raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
