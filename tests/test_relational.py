"""The relational cores: every query against its SQL on the small tables, and the streaming plans."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from specloom import queries as Q
from specloom.operators import constraints
from specloom.streaming import specs as stream

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df):
    f = lambda v: str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(map(f, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", Q.oracle_sql())
def test_query_agrees_with_sql(spark, duck, name):
    assert rows(Q.queries()[name](spark, SF).toPandas()) == rows(duck.sql(Q.oracle_sql()[name]).df())


def test_constraint_kinds(spark):
    df = spark.createDataFrame([("a@b.co", 1), ("bad", 9), (None, None)], "s string, n int")
    got = {r.check: r.violations for r in constraints.check(df, [("s", "email", None), ("s", "required", None), ("n", "max_value", 5), ("s", "unique", None), ("s", "uuid", None), ("s", "pattern", "a.*")]).collect()}
    assert got == {"s email": 1, "s required": 1, "n max_value": 1, "s unique": 0, "s uuid": 2, "s pattern": 1}
    with pytest.raises(ValueError):
        constraints.broken(F.col("s"), "odd")
    assert constraints.table_ddl([{"name": "a", "type": "int"}, {"name": "b", "type": "x", "required": False}]) == "`a` bigint NOT NULL, `b` variant"


def test_rules_that_can_be_run(spark):
    a = spark.createDataFrame([(1, 5, "x'y"), (2, -1, None), (3, None, "z")], "id int, price int, name string")
    b = spark.createDataFrame([(1, 4), (1, 6), (9, 9)], "a_id int, paid int")
    got = {r.check: r.violations for r in constraints.rule_violations({"a": a, "b": b}, {"p": "a.price > 0", "n": "a.name is not null", "c": "b.paid <= a.price", "t": "a.name <> \"x'y\""}, {("b", "a"): ("a_id", "id")}).collect()}
    assert got == {"p": 1, "n": 1, "c": 1, "t": 1}
    for bad in ("user.email must be unique", "a.x; drop table t", "f(a.x) > 1", "1 > 0", "a.b.c > 1"):
        with pytest.raises(ValueError):
            constraints.rule_expression(bad)
    with pytest.raises(ValueError):
        constraints.rule_violations({"a": a, "b": b}, {"c": "b.paid <= a.price"})


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.yaml").write_text("entities: [{id: '', fields: []}]")
    q = stream.validate_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).first().error_count == 1
    if os.path.isdir(SF):
        got = stream.counts_by_window(spark.read.parquet(f"{SF}/events.parquet"))
        assert got.agg(F.sum("n")).first()[0] == 1000
