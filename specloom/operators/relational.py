"""The relational cores behind rules, listings and migrations, for tables of any size.

Where a set rule can be said with a pre-aggregate it is: a key with very many rows then reaches the shuffle as one row for each task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import is_blank


def blank_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, rows, blank) in one pass: how many values are null or blank."""
    one = df.agg(F.count(F.lit(1)).alias("rows"), *(F.count_if(is_blank(F.col(c).cast("string"))).alias(f"b{k}") for k, c in enumerate(columns)))
    parts = F.array(*(F.struct(F.lit(c).alias("column"), F.col("rows"), F.col(f"b{k}").alias("blank")) for k, c in enumerate(columns)))
    return one.select(F.inline(parts))


def repeat_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, and how often after the first."""
    return df.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("repeats")).where("repeats > 0")


def repeats(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows after the first of their key, in order. The first is a minimum, so only rows of repeated keys meet again."""
    place = F.struct(*order)
    first = df.groupBy(*keys).agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return df.join(first, list(keys)).where(place > F.col("_first")).select(*df.columns)


def dangling(refs: DataFrame, ids: DataFrame, on: Column | list[str]) -> DataFrame:
    """References without a target."""
    return refs.join(ids, on, "left_anti")


def difference(rows: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of ``rows`` without those of ``done``: what is pending."""
    return rows.select(*keys).distinct().join(done.select(*keys), list(keys), "left_anti")


def with_child_counts(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, name: str) -> DataFrame:
    """Parents with the number of their children, 0 without. Children are counted before the join."""
    n = children.groupBy(F.col(child_key).alias(parent_key)).agg(F.count(F.lit(1)).alias(name))
    return parents.join(n, parent_key, "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)))


def survivors(adds: DataFrame, removals: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Rows that no later removal of their key undoes. Only each key's last removal matters, so it is a maximum and not a join of all pairs."""
    last = removals.groupBy(*keys).agg(F.max(order).alias("_last"))
    return adds.join(last, list(keys), "left").where(F.col("_last").isNull() | (F.col("_last") <= F.col(order))).drop("_last")


def last_value(df: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """For each key the value of its last row."""
    return df.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, "_r.*").select(*df.columns)


def last_n(df: DataFrame, partition: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The last n rows of each key, newest first, numbered from 1."""
    w = W.partitionBy(*partition).orderBy(*(F.col(c).desc() for c in order))
    return df.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n)


def matrix(df: DataFrame, row: str, col: str, values: Sequence[str]) -> DataFrame:
    """Counts by row, a column for each value; the values are given, so one pass suffices."""
    return df.groupBy(row).pivot(col, list(values)).agg(F.count(F.lit(1))).na.fill(0)


def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: keys on both sides, orphans of either, and the share of the left that is linked."""
    a, b = left.select(key).distinct().withColumn("l", F.lit(1)), right.select(key).distinct().withColumn("r", F.lit(1))
    both = F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull())
    return a.join(b, key, "full").agg(both.alias("linked"), F.count_if(F.col("r").isNull()).alias("left_orphans"), F.count_if(F.col("l").isNull()).alias("right_orphans"), (both / F.count("l")).alias("coverage"))


def violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check, violations): how many rows break each check, in one pass."""
    one = df.agg(*(F.count_if(c).alias(f"c{k}") for k, c in enumerate(checks.values())))
    return one.select(F.inline(F.array(*(F.struct(F.lit(n).alias("check"), F.col(f"c{k}").alias("violations")) for k, n in enumerate(checks)))))


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
