"""Each operator's relational core over the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import corpus
from .functions import scalars as S
from .operators import constraints, trace
from .operators import relational as R
from .streaming.specs import counts_by_window

NAMES = ["order_item", "user", "oRDER__x_", "get_user", "list_orders", "create_order", "add_item", "update_user", "modify_cart", "delete_user", "remove_item", "checkout", "getuser", ""]
KINDS = ["string", "int", "integer", "float", "double", "bool", "boolean", "date", "datetime", "uuid", "String", ""]
def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _values(spark: SparkSession, values: list[str], name: str = "x") -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def _sql_values(values: list[str], name: str = "x") -> str:
    return "(VALUES " + ", ".join(f"('{v}')" for v in values) + f") v({name})"


KEYS = [("region", "r_regionkey"), ("nation", "n_nationkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey"), ("orders", "o_orderkey"), ("events", "event_id"), ("documents", "doc_id"), ("pages", "page_id"), ("benchmark", "item_id")]


def required_ids_report(spark, sf):
    return R.union_all([R.blank_counts(_t(spark, sf, t), [k]).select(F.lit(t).alias("source"), F.col("rows").alias("n_rows"), F.col("blank").alias("n_blank")) for t, k in KEYS])


def duplicate_ids(spark, sf):
    return R.repeat_counts(_t(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


def duplicate_rows(spark, sf):
    rows = _t(spark, sf, "events").select("user_id", "event_type", "ts", "event_id")
    return R.repeats(rows, ["user_id", "event_type"], ["ts", "event_id"])


def duplicate_ids_global(spark, sf):
    keys = [_t(spark, sf, t).select(F.col(k).cast("long").alias("id")) for t, k in KEYS[2:6]]
    return R.repeat_counts(R.union_all(keys), ["id"])


def dangling_refs(spark, sf):
    lines = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return R.dangling(_t(spark, sf, "orders").select("o_orderkey", "o_custkey"), lines, ["o_orderkey"])


def required_fields(spark, sf):
    parts = [R.blank_counts(_t(spark, sf, t), cols).select(F.lit(t).alias("source"), F.col("column").alias("field"), F.col("blank").alias("n_blank")) for t, cols in (("documents", ["text", "lang", "source"]), ("customer", ["c_name", "c_mktsegment"]), ("conversations", ["role", "text"]))]
    return R.union_all(parts)


def list_with_counts(spark, sf):
    orders = _t(spark, sf, "orders").select("o_orderkey", F.coalesce("o_orderpriority", F.col("o_orderkey").cast("string")).alias("label"))
    return R.with_child_counts(orders, _t(spark, sf, "lineitem"), "o_orderkey", "l_orderkey", "n_lines")


def validation_summary(spark, sf):
    found = R.union_all(
        [
            dangling_refs(spark, sf).agg(F.count(F.lit(1)).alias("error_count")).select(F.lit("references").alias("rule"), "error_count"),
            duplicate_ids(spark, sf).agg(F.coalesce(F.sum("repeats"), F.lit(0)).alias("error_count")).select(F.lit("unique").alias("rule"), "error_count"),
            required_fields(spark, sf).agg(F.sum("n_blank").alias("error_count")).select(F.lit("required").alias("rule"), "error_count"),
        ]
    )
    return found.select("rule", "error_count", (F.col("error_count") == 0).alias("valid"))


def _days(spark, sf, kind):
    return _t(spark, sf, "events").where(F.col("event_type") == kind).select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))


def pending_set(spark, sf):
    return R.difference(_days(spark, sf, "signup"), _days(spark, sf, "purchase"), ["user_id", "day"])


def status_counts(spark, sf):
    e = _t(spark, sf, "events")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("value") >= 50).alias("applied"), F.count_if(F.col("value") < 50).alias("pending"))


def rollback_plan(spark, sf):
    return R.last_n(_t(spark, sf, "events").select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"], 3).select("user_id", "nth", "event_id")


def log_replay_survivors(spark, sf):
    e = _t(spark, sf, "events")
    kept = R.survivors(e.where("event_type = 'signup'"), e.where("event_type = 'error'"), ["user_id"], "ts")
    return kept.select("event_id", "user_id")


def last_modification_wins(spark, sf):
    return R.last_value(_t(spark, sf, "events"), ["user_id", "event_type"], "value", "ts")


def find_first(spark, sf):
    return R.first_row(_t(spark, sf, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


def retain_filter(spark, sf):
    gone = _t(spark, sf, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    return R.dangling(_t(spark, sf, "customer").select("c_custkey", "c_nationkey"), gone, ["c_nationkey"]).select("c_custkey", "c_nationkey")


def semi_filter(spark, sf):
    kept = _t(spark, sf, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"))
    return _t(spark, sf, "supplier").select("s_suppkey", "s_nationkey").join(kept, "s_nationkey", "left_semi").select("s_suppkey", "s_nationkey")


def positional_index(spark, sf):
    from pyspark.sql import Window as W

    w = W.partitionBy("conv_id").orderBy("turn")
    return _t(spark, sf, "conversations").select("conv_id", "turn", (F.row_number().over(w) - 1).cast("long").alias("position"))


REFERENCES = [("customer", "'c' || c_custkey", "'n' || c_nationkey"), ("supplier", "'s' || s_suppkey", "'n' || s_nationkey"), ("nation", "'n' || n_nationkey", "'r' || n_regionkey"), ("orders", "'o' || o_orderkey", "'c' || o_custkey")]


def topo_depth(spark, sf):
    edges = R.union_all([_t(spark, sf, t).select(F.expr(a).alias("child"), F.expr(b).alias("parent")) for t, a, b in REFERENCES])
    return trace.depths(edges, "child", "parent").select("node", F.col("depth").cast("long").alias("depth"))


def cycle_check(spark, sf):
    """The nations of a region lead to each other in a ring; suppliers lead to it, and the ring to customers. Every region leads to itself."""
    from pyspark.sql import Window as W

    key = lambda c: F.concat(F.lit("n"), F.lpad(c.cast("string"), 3, "0"))
    w = W.partitionBy("n_regionkey").orderBy("n_nationkey")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ring = _t(spark, sf, "nation").select(key(F.col("n_nationkey")).alias("s"), key(F.coalesce(F.lead("n_nationkey").over(w), F.first("n_nationkey").over(whole))).alias("t"))
    into = _t(spark, sf, "supplier").select(F.expr("'s' || s_suppkey").alias("s"), key(F.col("s_nationkey")).alias("t"))
    out = _t(spark, sf, "customer").select(key(F.col("c_nationkey")).alias("s"), F.expr("'c' || c_custkey").alias("t"))
    own = _t(spark, sf, "region").select(F.expr("'r' || r_regionkey").alias("s"), F.expr("'r' || r_regionkey").alias("t"))
    return trace.cycles(R.union_all([ring, into, out, own]), "s", "t")


def pascal_case(spark, sf):
    names = _t(spark, sf, "nation").select(F.lower("n_name").alias("x")).unionByName(_values(spark, NAMES))
    return names.select("x", S.pascal_case(F.col("x")).alias("pascal"))


#: Names and types over all parts, in SQL that both engines run: the kinds of names in turn before a part's name, the types in turn.
NAME_OF = "CASE p_partkey % 12 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(["get_", "list_", "create_", "add_", "update_", "modify_", "delete_", "remove_", "Get_", "getter_", "", "_get_"])) + " END || replace(lower(p_name), ' ', '_')"
TYPE_OF = "CASE p_partkey % 14 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate([*KINDS, "uuid ", "INT"])) + " END"


def http_verb(spark, sf):
    names = _t(spark, sf, "part").select(F.expr(NAME_OF).alias("x")).unionByName(_values(spark, NAMES))
    return names.select("x", S.http_verb(F.col("x")).alias("verb"))


def route_name(spark, sf):
    names = _t(spark, sf, "nation").select(F.col("n_name").alias("x")).unionByName(_values(spark, NAMES))
    return names.select("x", S.route_name(F.col("x")).alias("route"))


def type_map(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", F.expr(TYPE_OF).alias("x")).select("p_partkey", "x", *(S.type_name(F.col("x"), k).alias(k) for k in ("typescript", "python", "go")))


def sample_values(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", F.expr(TYPE_OF).alias("x")).select("p_partkey", "x", *(S.sample_value(F.col("x"), k).alias(k) for k in ("typescript", "python", "go")))


def default_literals(spark, sf):
    """Names, keys, balances and marks of all customers as JSON literals."""
    texts = F.expr("""array('"' || c_name || '"', cast(c_custkey as string), cast(c_acctbal as string), cast(c_custkey % 2 = 0 as string), '[' || c_custkey || ']')""")
    return _t(spark, sf, "customer").select(F.explode(texts).alias("x")).select("x", S.default_literal(F.col("x")).alias("literal"))


def cli_defaults(spark, sf):
    texts = F.expr("array(c_name, cast(c_custkey as string), cast(c_acctbal as string), cast(c_custkey % 2 = 0 as string), 'True', ' ' || c_custkey, c_custkey || 'd')")
    return _t(spark, sf, "customer").select(F.explode(texts).alias("x")).select("x", S.cli_default(F.col("x")).alias("json"))


def render_order_lines(spark, sf):
    line = F.concat(F.lit("  "), F.col("l_linenumber").cast("string"), F.lit(": "), F.col("l_partkey").cast("string"), F.lit(";\n"))
    rows = _t(spark, sf, "lineitem")
    listed = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", line.alias("t"))))
    return rows.groupBy("l_orderkey").agg(F.concat(F.lit("order "), F.first("l_orderkey").cast("string"), F.lit(" {\n"), F.array_join(F.transform(listed, lambda x: x["t"]), ""), F.lit("}\n")).alias("content"))


def constraint_violations(spark, sf):
    c = constraints.check(_t(spark, sf, "customer"), [("c_acctbal", "min_value", 0), ("c_acctbal", "max_value", 9000), ("c_name", "pattern", "Customer#[0-9]{9}"), ("c_name", "required", None), ("c_mktsegment", "max_length", 9)])
    o = constraints.check(_t(spark, sf, "orders"), [("o_orderstatus", "enum", ["F", "O"])])
    d = constraints.check(_t(spark, sf, "documents"), [("text", "unique", None), ("text", "min_length", 100)])
    return R.union_all([c, o, d])


RULES = {"balance": "customer.c_acctbal >= 0", "paid": "orders.o_totalprice > 2 * customer.c_acctbal or orders.o_orderstatus = 'F'", "placed": "nation.n_regionkey <> 2 and not supplier.s_acctbal < 100.5"}


def constraint_rules(spark, sf):
    tables = {t: _t(spark, sf, t) for t in ("customer", "orders", "nation", "supplier")}
    return constraints.rule_violations(tables, RULES, {("orders", "customer"): ("o_custkey", "c_custkey"), ("supplier", "nation"): ("s_nationkey", "n_nationkey")})


def coverage(spark, sf):
    return R.coverage(_t(spark, sf, "documents"), _t(spark, sf, "labels"), "doc_id")


def trace_matrix(spark, sf):
    return R.matrix(_t(spark, sf, "orders").select("o_orderpriority", "o_orderstatus"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


def element_counts(spark, sf):
    return _t(spark, sf, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.avg("n_chars").alias("mean_chars"))


def event_windows(spark, sf):
    """The plan of the event stream, over the whole table at once."""
    return counts_by_window(_t(spark, sf, "events")).select(F.col("window.start").alias("start"), "event_type", "n")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = """required_ids_report duplicate_ids duplicate_rows duplicate_ids_global dangling_refs required_fields list_with_counts validation_summary pending_set status_counts
    rollback_plan log_replay_survivors last_modification_wins find_first retain_filter semi_filter positional_index topo_depth cycle_check pascal_case http_verb route_name type_map sample_values
    default_literals cli_defaults render_order_lines constraint_violations constraint_rules coverage trace_matrix element_counts event_windows"""
    return {n: globals()[n] for n in names.split()} | corpus.queries()


def _case(table: dict[str, str], other: str, column: str = "x") -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE '{other}' END"


_VERB = "CASE " + " ".join(f"WHEN starts_with(x, '{k}') THEN '{v}'" for k, v in S.VERBS.items()) + f" ELSE '{S.OTHER_VERB}' END"
_WHITE = r"^\s+|\s+$"
_BLANK = "sum(CASE WHEN regexp_replace(coalesce({c}, ''), '" + _WHITE + "', '', 'g') = '' THEN 1 ELSE 0 END)"
_EVENT_DAY = "SELECT DISTINCT user_id, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE event_type = '{k}'"
_DUPLICATES = "SELECT l_orderkey, l_linenumber, count(*) - 1 AS repeats FROM lineitem GROUP BY ALL HAVING count(*) > 1"
_DANGLING = "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)"
_REQUIRED = " UNION ALL ".join(f"SELECT '{t}' AS source, '{c}' AS field, {_BLANK.format(c=c)} AS n_blank FROM {t}" for t, cs in (("documents", ("text", "lang", "source")), ("customer", ("c_name", "c_mktsegment")), ("conversations", ("role", "text"))) for c in cs)


def _rows(rows: list[tuple], names: str) -> str:
    q = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(q, r)) + ')' for r in rows)}) v({names})"


def oracle_sql() -> dict[str, str]:
    check = lambda name, test, table: f"SELECT '{name}' AS \"check\", count(*) FILTER ({test}) AS violations FROM {table}"
    return {
        "required_ids_report": " UNION ALL ".join(f"SELECT '{t}' AS source, count(*) AS n_rows, count(*) FILTER ({k} IS NULL) AS n_blank FROM {t}" for t, k in KEYS),
        "duplicate_ids": _DUPLICATES,
        "duplicate_rows": "SELECT user_id, event_type, ts, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n > 1",
        "duplicate_ids_global": "SELECT id, count(*) - 1 AS repeats FROM (" + " UNION ALL ".join(f"SELECT {k}::BIGINT AS id FROM {t}" for t, k in KEYS[2:6]) + ") GROUP BY id HAVING count(*) > 1",
        "dangling_refs": _DANGLING,
        "required_fields": _REQUIRED,
        "list_with_counts": "SELECT o_orderkey, coalesce(o_orderpriority, o_orderkey::VARCHAR) AS label, count(l_orderkey) AS n_lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL",
        "validation_summary": f"SELECT rule, error_count, error_count = 0 AS valid FROM (SELECT 'references' AS rule, count(*) AS error_count FROM ({_DANGLING}) UNION ALL SELECT 'unique', coalesce(sum(repeats), 0)::BIGINT FROM ({_DUPLICATES}) UNION ALL SELECT 'required', sum(n_blank)::BIGINT FROM ({_REQUIRED}))",
        "pending_set": _EVENT_DAY.format(k="signup") + " EXCEPT " + _EVENT_DAY.format(k="purchase"),
        "status_counts": "SELECT event_type, count(*) AS total, count(*) FILTER (value >= 50) AS applied, count(*) FILTER (value < 50) AS pending FROM events GROUP BY 1",
        "rollback_plan": "SELECT user_id, nth, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::INT AS nth FROM events) WHERE nth <= 3",
        "log_replay_survivors": "SELECT event_id, user_id FROM events a WHERE event_type = 'signup' AND NOT EXISTS (SELECT 1 FROM events r WHERE r.event_type = 'error' AND r.user_id = a.user_id AND r.ts > a.ts)",
        "last_modification_wins": "SELECT user_id, event_type, max_by(value, ts) AS value FROM events GROUP BY ALL",
        "find_first": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n = 1",
        "retain_filter": "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
        "semi_filter": "SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
        "positional_index": "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position FROM conversations",
        "topo_depth": "WITH RECURSIVE e AS (" + " UNION ".join(f"SELECT {a} AS c, {b} AS p FROM {t}" for t, a, b in REFERENCES) + "), w(node, depth) AS (SELECT DISTINCT p, 0 FROM e WHERE p NOT IN (SELECT c FROM e) UNION ALL SELECT e.c, w.depth + 1 FROM w JOIN e ON e.p = w.node) SELECT node, max(depth)::BIGINT AS depth FROM w GROUP BY node",
        "cycle_check": "WITH n AS (SELECT n_regionkey, 'n' || lpad(n_nationkey::VARCHAR, 3, '0') AS x FROM nation) SELECT min(x) AS node, string_agg(x, ' -> ' ORDER BY x) || ' -> ' || min(x) AS path FROM n GROUP BY n_regionkey UNION ALL SELECT 'r' || r_regionkey, 'r' || r_regionkey || ' -> r' || r_regionkey FROM region",
        "pascal_case": f"SELECT x, array_to_string(list_transform(string_split(x, '_'), lambda w: upper(w[1]) || w[2:]), '') AS pascal FROM (SELECT lower(n_name) AS x FROM nation UNION ALL SELECT x FROM {_sql_values(NAMES)})",
        "http_verb": f"SELECT x, {_VERB} AS verb FROM (SELECT {NAME_OF} AS x FROM part UNION ALL SELECT x FROM {_sql_values(NAMES)})",
        "route_name": f"SELECT x, replace(x, '_', '-') AS route FROM (SELECT n_name AS x FROM nation UNION ALL SELECT x FROM {_sql_values(NAMES)})",
        "type_map": f"SELECT p_partkey, x, {', '.join(f'{_case(S.TYPES[k], S.OTHER_TYPE[k])} AS {k}' for k in ('typescript', 'python', 'go'))} FROM (SELECT p_partkey, {TYPE_OF} AS x FROM part)",
        "sample_values": f"SELECT p_partkey, x, {', '.join(f'{_case(S.SAMPLES[k], S.OTHER_SAMPLE[k])} AS {k}' for k in ('typescript', 'python', 'go'))} FROM (SELECT p_partkey, {TYPE_OF} AS x FROM part)",
        "default_literals": """SELECT '"' || c_name || '"' AS x, '"' || c_name || '"' AS literal FROM customer UNION ALL SELECT c_custkey::VARCHAR, c_custkey::VARCHAR FROM customer UNION ALL SELECT c_acctbal::VARCHAR, CASE WHEN c_acctbal = round(c_acctbal) THEN c_acctbal::BIGINT::VARCHAR ELSE c_acctbal::VARCHAR END FROM customer
            UNION ALL SELECT CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END, CASE WHEN c_custkey % 2 = 0 THEN 'True' ELSE 'False' END FROM customer UNION ALL SELECT '[' || c_custkey || ']', 'None' FROM customer""",
        "cli_defaults": """SELECT c_name AS x, '"' || c_name || '"' AS json FROM customer UNION ALL SELECT c_custkey::VARCHAR, c_custkey::DOUBLE::VARCHAR FROM customer UNION ALL SELECT c_acctbal::VARCHAR, c_acctbal::VARCHAR FROM customer UNION ALL SELECT CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END, CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END FROM customer
            UNION ALL SELECT 'True', '"True"' FROM customer UNION ALL SELECT ' ' || c_custkey, '" ' || c_custkey || '"' FROM customer UNION ALL SELECT c_custkey || 'd', '"' || c_custkey || 'd"' FROM customer""",
        "render_order_lines": "SELECT l_orderkey, 'order ' || l_orderkey || ' {' || chr(10) || string_agg('  ' || l_linenumber || ': ' || l_partkey || ';' || chr(10), '' ORDER BY l_linenumber, l_partkey) || '}' || chr(10) AS content FROM lineitem GROUP BY l_orderkey",
        "constraint_violations": " UNION ALL ".join(
            [
                check("c_acctbal min_value", "c_acctbal < 0", "customer"), check("c_acctbal max_value", "c_acctbal > 9000", "customer"), check("c_name pattern", "NOT regexp_full_match(c_name, 'Customer#[0-9]{9}')", "customer"),
                check("c_name required", "c_name IS NULL", "customer"), check("c_mktsegment max_length", "length(c_mktsegment) > 9", "customer"), check("o_orderstatus enum", "o_orderstatus NOT IN ('F', 'O')", "orders"),
                check("text min_length", "length(text) < 100", "documents"), "SELECT 'text unique', coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1)",
            ]
        ),
        "constraint_rules": "SELECT 'balance' AS \"check\", count(*) FILTER (NOT c_acctbal >= 0) AS violations FROM customer UNION ALL SELECT 'paid', count(*) FILTER (o_totalprice <= 2 * c_acctbal AND o_orderstatus <> 'F') FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT 'placed', count(*) FILTER (n_regionkey = 2 OR s_acctbal < 100.5) FROM supplier JOIN nation ON s_nationkey = n_nationkey",
        "coverage": "SELECT count(*) FILTER (a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL) AS linked, count(*) FILTER (b.doc_id IS NULL) AS left_orphans, count(*) FILTER (a.doc_id IS NULL) AS right_orphans, count(*) FILTER (a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL) / count(a.doc_id) AS coverage FROM (SELECT DISTINCT doc_id FROM documents) a FULL JOIN (SELECT DISTINCT doc_id FROM labels) b ON a.doc_id = b.doc_id",
        "trace_matrix": "SELECT o_orderpriority, " + ", ".join(f"count(*) FILTER (o_orderstatus = '{s}') AS {s}" for s in "FOP") + " FROM orders GROUP BY 1",
        "element_counts": "SELECT lang, source, count(*) AS n, avg(n_chars) AS mean_chars FROM documents GROUP BY ALL",
        "event_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    } | corpus.oracle_sql()
