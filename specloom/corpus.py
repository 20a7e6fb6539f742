"""A corpus of specifications made from the driver's tables, queries that run the specification engine on it, and the same results in DuckDB SQL.

There is one document for each nation: its suppliers are entities, actions and links, the regions are features, flows and constraints. Defects of every kind are planted by keys. The rows below
are plain SQL that both engines run; Spark makes documents of them, which pass through the YAML reader as texts, while DuckDB computes each result straight from the rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import migrate, render, rules, trace
from .operators import relational as R
from .plans.catalog import Catalog
from .shipping import stored
from .sources.specs import parse_specs

TABLES = ("supplier", "nation", "region")
#: Elements of the documents. Placeholders in braces are tables.
ELEMENTS = {
    "ent": """SELECT n_name AS doc, CAST(row_number() OVER (PARTITION BY n_name ORDER BY s_suppkey) - 1 AS INT) AS ord, s_suppkey AS k,
        CASE WHEN s_suppkey % 17 = 0 THEN '' WHEN s_suppkey % 13 = 0 THEN 'twice_over' ELSE 'part_' || CAST(s_suppkey AS STRING) END AS id, s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'Sold by ' || s_name END AS description
        FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""",
    "fld": """SELECT doc, ord, k, sub, CASE sub WHEN 0 THEN 'id' WHEN 1 THEN CASE WHEN k % 11 = 0 THEN '' ELSE 'acct_balance' END ELSE 'note' END AS name,
        CASE WHEN sub = 0 THEN 'int' WHEN sub = 1 THEN 'float' WHEN k % 7 = 0 THEN '' ELSE CASE k % 6 WHEN 0 THEN 'string' WHEN 1 THEN 'boolean' WHEN 2 THEN 'date' WHEN 3 THEN 'datetime' WHEN 4 THEN 'uuid' ELSE 'odd' END END AS type,
        CASE WHEN sub > 0 THEN k % 3 <> 0 END AS required, CASE WHEN sub = 1 AND k % 5 = 0 THEN '1.5' WHEN sub = 2 AND k % 5 = 1 THEN '"none"' WHEN sub = 2 AND k % 5 = 2 THEN 'true' WHEN sub = 0 AND k % 5 = 3 THEN '18' END AS fallback
        FROM ({ent}) e CROSS JOIN (SELECT 0 AS sub UNION ALL SELECT 1 UNION ALL SELECT 2) t""",
    "act": """SELECT doc, ord, k, CASE WHEN k % 19 = 0 THEN '' ELSE CASE k % 6 WHEN 0 THEN 'get' WHEN 1 THEN 'create' WHEN 2 THEN 'update' WHEN 3 THEN 'delete' WHEN 4 THEN 'list' ELSE 'ship' END || '_part_' || CAST(k AS STRING) END AS id,
        k % 4 <> 0 AS takes, CASE WHEN k % 4 >= 2 THEN 'part_' || CAST(k AS STRING) END AS entity FROM ({ent}) e""",
    "feat": """SELECT n_name AS doc, r_regionkey AS ord, CASE WHEN (n_nationkey + r_regionkey) % 9 = 0 THEN '' ELSE 'f' || CAST(r_regionkey AS STRING) END AS id, CASE WHEN (n_nationkey + r_regionkey) % 7 = 0 THEN '' ELSE r_name END AS title,
        CASE WHEN (n_nationkey + r_regionkey) % 6 = 0 THEN 'gone' ELSE 'f' || CAST((r_regionkey + 1) % 5 AS STRING) END AS needs, n_nationkey AS n FROM {nation} CROSS JOIN {region}""",
    "scen": """SELECT doc, ord, sub, id AS feature, CASE WHEN (n + ord + sub) % 10 = 0 THEN '' WHEN (n + ord + sub) % 8 = 0 THEN 'twice_over' ELSE 's' || CAST(ord AS STRING) || '_' || CAST(sub AS STRING) END AS id,
        CASE WHEN (n + ord + sub) % 11 = 0 THEN '' ELSE title || ' ' || CAST(sub AS STRING) END AS title FROM ({feat}) f CROSS JOIN (SELECT 0 AS sub UNION ALL SELECT 1) t""",
    "flow": """SELECT doc, ord, CASE WHEN (n + ord) % 8 = 1 THEN '' ELSE 'w' || CAST(ord AS STRING) END AS id, CASE WHEN (n + ord) % 5 = 1 THEN '' ELSE 'Flow ' || CAST(ord AS STRING) END AS name FROM ({feat}) f""",
    "cons": """SELECT doc, ord, CASE WHEN (n + ord) % 8 = 2 THEN '' ELSE 'c' || CAST(ord AS STRING) END AS id, CASE WHEN (n + ord) % 5 = 2 THEN '' ELSE 'Rule ' || CAST(ord AS STRING) END AS name, CASE WHEN (n + ord) % 4 = 2 THEN '' ELSE 'total > ' || CAST(ord AS STRING) END AS rule
        FROM ({feat}) f""",
    "link": """SELECT a.doc AS doc, a.ord AS ord, CASE WHEN k % 23 = 0 THEN 'away' ELSE 'f' || CAST(k % 5 AS STRING) END AS src, CASE WHEN k % 29 = 0 THEN 'nowhere' ELSE a.id END AS dst, CASE WHEN k % 9 = 0 THEN 'odd' ELSE 'implements' END AS relation
        FROM ({act}) a""",
}


def _expanded(name: str) -> str:
    text = ELEMENTS[name]
    for other in ELEMENTS:
        if "{" + other + "}" in text:
            text = text.replace("{" + other + "}", _expanded(other))
    return text


def _frame(spark: SparkSession, sf: str, text: str) -> DataFrame:
    return spark.sql(text, **{t: spark.read.parquet(f"{sf}/{t}.parquet") for t in TABLES if "{" + t + "}" in text})


def elements(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return _frame(spark, sf, _expanded(name))


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """(doc, text): the documents as YAML, in flow style."""
    rows = {k: elements(spark, sf, k) for k in ELEMENTS}
    listed = lambda df, *keys, order, **cols: df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, F.struct(*(c.alias(n) for n, c in cols.items())).alias("e")))), lambda x: x["e"]).alias("_list"))
    c = F.col
    fields = listed(rows["fld"], "doc", "ord", order="sub", name=c("name"), type=c("type"), required=c("required"), default=c("fallback")).withColumnRenamed("_list", "fields")
    words = lambda *w: F.array(*w)
    scenarios = listed(rows["scen"], "doc", "ord", order="sub", id=c("id"), title=c("title"), given=words(F.concat(F.lit("given "), "title"), F.lit("ready")), when=words(F.lit("done")), then=words(F.concat(F.lit("then "), "id"))).withColumnRenamed("_list", "scenarios")
    parts = {
        "entities": listed(rows["ent"].join(fields, ["doc", "ord"]), "doc", order="ord", id=c("id"), name=c("name"), description=c("description"), fields=c("fields")),
        "actions": listed(rows["act"], "doc", order="ord", id=c("id"), input=F.when(c("takes"), F.struct(c("entity").alias("entity"), F.array(F.lit("id")).alias("fields")))),
        "features": listed(rows["feat"].join(scenarios, ["doc", "ord"]), "doc", order="ord", id=c("id"), title=c("title"), scenarios=c("scenarios"), dependencies=F.array("needs")),
        "flows": listed(rows["flow"], "doc", order="ord", id=c("id"), name=c("name"), steps=F.array().cast("array<string>")),
        "constraints": listed(rows["cons"], "doc", order="ord", id=c("id"), name=c("name"), type=F.lit("rule"), rule=c("rule")),
        "traceability": listed(rows["link"], "doc", order="ord", **{"from": c("src"), "to": c("dst")}, relation=c("relation")),
    }
    docs = rows["feat"].select("doc").distinct()
    for name, part in parts.items():
        docs = docs.join(part.withColumnRenamed("_list", name), "doc", "left")
    # defaults are literals, not texts
    whole = F.regexp_replace(F.to_json(F.struct(*parts)), r'"default":"((?:[^"\\]|\\.)*)"', '"default":$1')
    return docs.select("doc", F.replace(whole, F.lit(':\\"none\\"'), F.lit(':"none"')).alias("text"))


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """The documents, parsed once and stored: a query of several rules reads them several times."""
    return stored(parse_specs(texts(spark, sf).repartition(8, "doc"), "FAILFAST"))


def spec_validation(spark, sf):
    return rules.validate(corpus(spark, sf)).select("doc", "rule", "section", "ord", "sub", "check", "message")


def spec_report(spark, sf):
    docs = corpus(spark, sf)
    return rules.report(docs, rules.validate(docs)).select("doc", "valid", F.col("error_count").cast("long").alias("error_count"), F.array_join("errors", "\n").alias("errors"))


def spec_listing(spark, sf):
    docs = corpus(spark, sf)
    return R.union_all([rules.listing(docs, k).select("doc", F.lit(k).alias("kind"), "ord", "id", "label", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("rule", F.lit("")).alias("rule_text")) for k in ("entities", "features", "actions", "constraints")])


def spec_steps(spark, sf):
    return Catalog(corpus(spark, sf)).steps().select("doc", "feature", "scenario", "ord", "sub", "phase", "n", "text")


def spec_render(spark, sf):
    """All files of the three languages."""
    docs = corpus(spark, sf)
    return R.union_all([render.generate(docs, k).select("doc", F.lit(k).alias("language"), "path", "content", "keep_existing") for k in ("typescript", "python", "go")])


def spec_tests(spark, sf):
    docs = corpus(spark, sf)
    return R.union_all([render.tests(docs, k).select("doc", F.lit(k).alias("language"), "path", "content") for k in ("typescript", "python", "go")])


def spec_links(spark, sf):
    return trace.validate(corpus(spark, sf)).select("doc", F.col("from").alias("source"), F.col("to").alias("target"), "relation", "problem")


def spec_link_forms(spark, sf):
    return trace.link_forms(corpus(spark, sf)).select("doc", F.col("from").alias("source"), F.col("to").alias("target"), "relation", "problem")


def spec_graph(spark, sf):
    return trace.graph(corpus(spark, sf))


def spec_matrix(spark, sf):
    return trace.matrix(corpus(spark, sf)).select("doc", F.col("from").alias("source"), F.array_join(F.transform("links", lambda x: F.concat(x["to"], F.lit(" "), x["relation"])), "\n").alias("cells"))


def spec_coverage(spark, sf):
    return trace.coverage(corpus(spark, sf))


def spec_cycles(spark, sf):
    """Cycles among the dependencies of each document's features."""
    return trace.cycles(Catalog(corpus(spark, sf)).dependencies(), group="doc").select("doc", "node", "path")


# --- migrations

#: One operation for each supplier, of the 13 kinds in turn; the kinds meet no element of another operation, so the result can be said by sets. Every tenth nation begins with one that fails.
OPERATIONS = """SELECT n_name AS doc, CAST(s_suppkey AS INT) AS seq, s_suppkey AS k, n_nationkey % 10 = 9 AS fails,
    CASE s_suppkey % 13 WHEN 0 THEN 'add_feature' WHEN 1 THEN 'remove_feature' WHEN 2 THEN 'add_entity' WHEN 3 THEN 'remove_entity' WHEN 4 THEN 'modify_entity' WHEN 5 THEN 'add_action' WHEN 6 THEN 'remove_action'
        WHEN 7 THEN 'add_constraint' WHEN 8 THEN 'remove_constraint' WHEN 9 THEN 'add_field' WHEN 10 THEN 'remove_field' WHEN 11 THEN 'update_action' ELSE 'change_validation' END AS type,
    CASE s_suppkey % 13 WHEN 1 THEN 'f' || CAST(s_suppkey % 5 AS STRING) WHEN 8 THEN 'c' || CAST(s_suppkey % 5 AS STRING) WHEN 3 THEN 'e' || CAST(s_suppkey AS STRING) WHEN 4 THEN 'e' || CAST(s_suppkey AS STRING)
        WHEN 6 THEN 'a' || CAST(s_suppkey AS STRING) WHEN 11 THEN 'a' || CAST(s_suppkey AS STRING) ELSE 'new' || CAST(s_suppkey AS STRING) END AS id,
    CASE WHEN s_suppkey % 4 = 0 THEN ' ' ELSE 'Name ' || s_name END AS name, 'e' || CAST(s_suppkey AS STRING) AS target FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey"""


def _operations(spark, sf) -> DataFrame:
    o = _frame(spark, sf, OPERATIONS)
    one = {"type": "type", "id": "id", "title": "name", "name": "name", "description": "cast(null as string)", "condition": "'x > 0'", "applies_to": "target", "entity_id": "target", "field_name": "if(type = 'remove_field', 'note', 'extra')", "field_type": "'int'", "default": "'7'", "new_name": "name", "target_id": "target", "target_type": "'entity'"}
    return o.select("doc", "seq", "fails", F.struct(*(F.expr(e).alias(n) for n, e in one.items()), F.array(F.lit("First"), F.col("name")).alias("scenarios")).alias("op"))


def _plain_documents(spark, sf) -> DataFrame:
    """Documents without defects: for each supplier an entity of two fields and an action; five features and constraints."""
    s = _frame(spark, sf, "SELECT n_name AS doc, s_suppkey AS k, s_name AS name FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey")
    fields = "array(named_struct('name', 'id', 'type', 'int'), named_struct('name', 'note', 'type', 'string'))"
    entity, action = F.expr(f"named_struct('k', k, 'id', 'e' || k, 'name', name, 'fields', {fields})"), F.expr("named_struct('k', k, 'id', 'a' || k, 'name', name)")
    per = s.groupBy("doc").agg(F.array_sort(F.collect_list(entity)).alias("entities"), F.array_sort(F.collect_list(action)).alias("actions"))
    of = lambda e: F.transform(F.sequence(F.lit(0), F.lit(4)), e)
    features = of(lambda i: F.struct(F.concat(F.lit("f"), i).alias("id"), F.concat(F.lit("F"), i).alias("title"), F.array().cast("array<string>").alias("scenarios")))
    cons = of(lambda i: F.struct(F.concat(F.lit("c"), i).alias("id"), F.concat(F.lit("C"), i).alias("name"), F.lit("rule").alias("type"), F.lit("x").alias("rule")))
    return parse_specs(per.select("doc", F.to_json(F.struct("entities", "actions", features.alias("features"), cons.alias("constraints"))).alias("text")).repartition(8, "doc"), "FAILFAST")


def _migrated(spark, sf) -> DataFrame:
    ops = _operations(spark, sf)
    lost = ops.where("fails").groupBy("doc").agg(F.lit(-1).alias("seq"), F.first(F.col("op").withField("type", F.lit("remove_field")).withField("entity_id", F.lit("nobody"))).alias("op"))
    return stored(migrate.replay_corpus(_plain_documents(spark, sf), ops.select("doc", "seq", "op").unionByName(lost)))


def spec_migration(spark, sf):
    """What all 13 operations leave in each section."""
    done = _migrated(spark, sf)
    c = Catalog(done)
    label = {"features": "e.title", "constraints": "e.rule"}
    size = {"entities": F.size("e.fields"), "features": F.size("e.scenarios")}
    return R.union_all([c.section(s).select("doc", F.lit(s).alias("kind"), "ord", F.col("e.id").alias("id"), F.col(label.get(s, "e.name")).alias("label"), size.get(s, F.lit(0)).alias("n_parts")) for s in ("entities", "features", "actions", "constraints")])


def spec_migration_fields(spark, sf):
    return Catalog(_migrated(spark, sf)).fields().select("doc", "entity", "ord", "sub", "name", "type", F.coalesce("default", F.lit("")).alias("fallback"))


def spec_migration_errors(spark, sf):
    return _migrated(spark, sf).select("doc", F.coalesce("error", F.lit("")).alias("error"))


def operation_checks(spark, sf):
    """All operations, with names that are blank for every fourth: what is wrong with their own texts."""
    return _operations(spark, sf).select("seq", "op.*", F.lit(None).cast("string").alias("message")).select("seq", "type", F.coalesce(migrate.operation_errors(), F.lit("")).alias("error"))


def operation_lines(spark, sf):
    return _operations(spark, sf).select("seq", "op.*").select("seq", "type", migrate.describe().alias("line"))


#: Migrations are the nations; a state names those of four regions, and one whose file is gone.
MIGRATIONS = """SELECT 'm' || CAST(n_nationkey + 10 AS STRING) AS id, CASE WHEN n_nationkey % 5 > 0 THEN 'm' || CAST(n_nationkey + 9 AS STRING) END AS needs, n_nationkey % 4 = 1 AS no_down, n_nationkey % 4 = 2 AS bad_down, n_regionkey <> 2 AS applied, n_nationkey AS k FROM {nation}"""


def _migrations(spark, sf) -> tuple[DataFrame, DataFrame]:
    m = _frame(spark, sf, MIGRATIONS)
    kinds = "type string, id string, title string, name string, condition string, applies_to string, entity_id string, field_name string, field_type string"
    down = F.from_json(F.when(F.col("no_down"), "[]").when(F.col("bad_down"), '[{"type": "remove_entity", "id": " "}]').otherwise('[{"type": "remove_entity", "id": "e"}]'), f"array<struct<{', '.join(x.replace(' ', ': ', 1) for x in kinds.split(', '))}>>")
    found = m.select("id", F.struct(F.when(F.col("needs").isNotNull(), F.array("needs")).alias("dependencies"), down.alias("down")).alias("migration"))
    applied = m.where("applied").select(F.col("k").cast("int").alias("ord"), "id").unionByName(spark.createDataFrame([(99, "m99")], "ord int, id string"))
    return found, applied


def migration_status(spark, sf):
    s = migrate.status(*_migrations(spark, sf))
    return s.select("total", "applied_count", "pending_count", F.array_join("applied", " ").alias("applied"), F.array_join("pending", " ").alias("pending"))


def migration_order(spark, sf):
    """Pending migrations in the order of their dependencies."""
    return spark.createDataFrame(list(enumerate(migrate.plan(*_migrations(spark, sf)))), "place long, id string")


def migration_rollback(spark, sf):
    found, applied = _migrations(spark, sf)
    took = migrate.rollback_plan(applied, 12).select("ord", "id", F.lit("").alias("error"))
    return took.unionByName(migrate.rollback_errors(applied, found, 12).select("ord", "id", "error"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = """spec_validation spec_report spec_listing spec_steps spec_render spec_tests spec_links spec_link_forms spec_graph spec_matrix spec_coverage spec_cycles spec_migration spec_migration_fields spec_migration_errors
    operation_checks operation_lines migration_status migration_order migration_rollback"""
    return {n: globals()[n] for n in names.split()}


# --- the same in DuckDB

_PLAIN = {t: t for t in TABLES}
_WITH = "WITH " + ", ".join(f"{k} AS MATERIALIZED ({_expanded(k).format(**_PLAIN)})" for k in ELEMENTS)
_OPS = f"WITH o AS MATERIALIZED ({OPERATIONS.format(**_PLAIN)})"
_NL = "chr(10)"


def _validation() -> str:
    empty = lambda table, section, part, check, message: f"SELECT doc, 0 AS rule, {section} AS section, ord, -1 AS sub, {check} AS \"check\", {message} AS message FROM {table} WHERE {part} = ''"
    at = lambda kind: f"'{kind} at index ' || ord || ' is missing required ''id'' field'"
    of = lambda kind, part: f"'{kind} ''' || id || ''' is missing required ''{part}'' field'"
    found = [empty(t, n, "id", 0, at(kind)) for t, n, kind in (("ent", 0, "Entity"), ("feat", 1, "Feature"), ("act", 2, "Action"), ("flow", 3, "Flow"), ("cons", 4, "Constraint"))]
    found += [empty("feat", 1, "title", 1, of("Feature", "title")), empty("flow", 3, "name", 1, of("Flow", "name")), empty("cons", 4, "name", 1, of("Constraint", "name")), empty("cons", 4, "rule", 2, of("Constraint", "rule"))]
    found += ["SELECT doc, 0, 1, ord, sub, 0, 'Scenario at index ' || sub || ' in feature ''' || feature || ''' is missing required ''id'' field' FROM scen WHERE id = ''", "SELECT doc, 0, 1, ord, sub, 1, 'Scenario ''' || id || ''' in feature ''' || feature || ''' is missing required ''title'' field' FROM scen WHERE title = ''"]
    found += ["SELECT doc, 1, section, ord, sub, 0, 'Duplicate ID found: ''' || id || '''' FROM (SELECT *, row_number() OVER (PARTITION BY doc, id ORDER BY section, ord, sub) AS nth FROM ids WHERE id <> '') WHERE nth > 1"]
    found += ["SELECT doc, 2, 1, ord, 0, 0, 'Feature ''' || id || ''' references unknown dependency: ''' || needs || '''' FROM feat WHERE (doc, needs) NOT IN (SELECT doc, id FROM ids)"]
    found += [f"SELECT doc, 2, 5, ord, -1, {n}, 'Traceability references unknown ''{name}'' element: ''' || {col} || '''' FROM link WHERE (doc, {col}) NOT IN (SELECT doc, id FROM ids)" for n, (name, col) in enumerate((("from", "src"), ("to", "dst")))]
    found += ["SELECT f.doc, 3, 0, f.ord, f.sub, 0, 'Field in entity ''' || e.id || ''' is missing required ''name''' FROM fld f JOIN ent e USING (doc, ord) WHERE f.name = ''", "SELECT f.doc, 3, 0, f.ord, f.sub, 1, 'Field ''' || f.name || ''' in entity ''' || e.id || ''' is missing required ''type''' FROM fld f JOIN ent e USING (doc, ord) WHERE f.type = ''"]
    return f"{_IDS}, found AS ({' UNION ALL '.join(found)})"


_IDS = f"{_WITH}, ids AS (SELECT doc, 0 AS section, ord, -1 AS sub, id FROM ent UNION ALL SELECT doc, 1, ord, -1, id FROM feat UNION ALL SELECT doc, 1, ord, sub, id FROM scen UNION ALL SELECT doc, 2, ord, -1, id FROM act UNION ALL SELECT doc, 3, ord, -1, id FROM flow UNION ALL SELECT doc, 4, ord, -1, id FROM cons)"


def _pascal(x: str) -> str:
    return f"array_to_string(list_transform(string_split({x}, '_'), lambda w: upper(w[1]) || w[2:]), '')"


def _case(table: dict[str, str], other: str, x: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE '{other}' END"


def _verb(x: str) -> str:
    return "CASE " + " ".join(f"WHEN starts_with({x}, '{k}') THEN '{v}'" for k, v in S.VERBS.items()) + f" ELSE '{S.OTHER_VERB}' END"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _per_field(line: str, name: str) -> str:
    return f"{name} AS (SELECT doc, ord, string_agg({line}, '' ORDER BY sub) AS body FROM fld GROUP BY doc, ord)"


def _render() -> str:
    kind = lambda lang: _case(S.TYPES[lang], S.OTHER_TYPE[lang], "type")
    need = "coalesce(required, true)"
    parts = [
        _per_field(f"'  ' || name || CASE WHEN {need} THEN '' ELSE '?' END || ': ' || {kind('typescript')} || ';' || {_NL}", "ts"),
        _per_field(f"""'    ' || name || ': ' || CASE WHEN {need} THEN {kind('python')} ELSE 'Optional[' || {kind('python')} || ']' END || CASE WHEN fallback IS NOT NULL THEN ' = ' || CASE fallback WHEN 'true' THEN 'True' ELSE fallback END WHEN NOT {need} THEN ' = None' ELSE '' END || {_NL}""", "py"),
        _per_field(f"""'    ' || {_pascal('name')} || ' ' || {kind('go')} || ' `json:"' || name || '"`' || {_NL}""", "gof"),
    ]
    entity = lambda lang, path, head, each, body: f"SELECT e.doc, '{lang}' AS language, '{path}' AS path, {_q(head)} || string_agg({each}, '' ORDER BY e.ord) AS content, false AS keep_existing FROM ent e JOIN {body} b USING (doc, ord) GROUP BY e.doc"
    action = lambda lang, path, head, each, tail: f"SELECT doc, '{lang}', '{path}', {_q(head)} || string_agg({each}, '' ORDER BY ord) || {tail}, false FROM act GROUP BY doc"
    files = [
        entity("typescript", "types.ts", "// Generated entity interfaces\n\n", f"'export interface ' || {_pascal('e.id')} || ' {{' || {_NL} || body || '}}' || {_NL} || {_NL}", "ts"),
        entity("python", "models.py", "from pydantic import BaseModel\nfrom typing import Optional, List, Any\nfrom datetime import date, datetime\n\n", f"""'class ' || {_pascal('e.id')} || '(BaseModel):' || {_NL} || CASE WHEN description IS NOT NULL THEN '    \"\"\"' || description || '\"\"\"' || {_NL} ELSE '' END || body || {_NL}""", "py"),
        entity("go", "types.go", 'package main\n\nimport "time"\n\n', f"'type ' || {_pascal('e.id')} || ' struct {{' || {_NL} || body || '}}' || {_NL} || {_NL}", "gof"),
        action("typescript", "routes.ts", "import express from 'express';\nconst router = express.Router();\n\n", f"'router.' || lower({_verb('id')}) || '(''/' || replace(id, '_', '-') || ''', (req, res) => {{' || {_NL} || '  // TODO: Implement action logic' || {_NL} || CASE WHEN takes THEN '  // Input: ' || coalesce(entity, 'unknown') || {_NL} ELSE '' END || '  res.status(501).json({{ error: ''Not implemented'' }});' || {_NL} || '}});' || {_NL} || {_NL}", _q("export default router;\n")),
        action("python", "routes.py", "from fastapi import APIRouter, HTTPException\nfrom typing import List, Optional\nfrom .models import *\n\nrouter = APIRouter()\n\n", f"""'@router.' || lower({_verb('id')}) || '("/' || replace(id, '_', '-') || '")' || {_NL} || 'async def ' || id || '(' || CASE WHEN takes THEN 'data: ' || coalesce({_pascal('entity')}, 'dict') ELSE '' END || '):' || {_NL} || '    \"\"\"TODO: Implement action logic\"\"\"' || {_NL} || '    raise HTTPException(status_code=501, detail="Not implemented")' || {_NL} || {_NL}""", "''"),
        action("go", "handlers.go", 'package main\n\nimport (\n    "encoding/json"\n    "net/http"\n    "github.com/gin-gonic/gin"\n)\n\n', f"""'func ' || {_pascal('id')} || '(c *gin.Context) {{' || {_NL} || CASE WHEN takes THEN '    var req ' || coalesce({_pascal('entity')}, 'interface{{}}') || {_NL} || {_q('    if err := c.ShouldBindJSON(&req); err != nil {{{{' + chr(10) + '        c.JSON(http.StatusBadRequest, gin.H{{{{"error": err.Error()}}}})' + chr(10) + '        return' + chr(10) + '    }}}}' + chr(10) + chr(10)).replace('{{{{', '{{').replace('}}}}', '}}')} ELSE '' END || {_q('    // TODO: Implement action logic' + chr(10) + '    c.JSON(http.StatusNotImplemented, gin.H{{"error": "Not implemented"}})' + chr(10) + '}}' + chr(10) + chr(10))}""", f"""{_q('func SetupRoutes(r *gin.Engine) {{' + chr(10) + '    api := r.Group("/api")' + chr(10))} || string_agg('    api.' || {_verb('id')} || '("/' || replace(id, '_', '-') || '", ' || {_pascal('id')} || ')' || {_NL}, '' ORDER BY ord) || '}}' || {_NL}"""),
    ]
    files = [f.replace("{{", "{").replace("}}", "}") for f in files]
    files += [f"SELECT DISTINCT doc, '{lang}', '{path}', {_q(text)}, true FROM feat" for lang, constant in render.MANIFESTS.items() for path, text in constant("Generated API").items()]
    return f"{_WITH}, {', '.join(parts)} {' UNION ALL '.join(files)}"


def _tests() -> str:
    value = lambda lang: _case({k: v.replace("'", "''") for k, v in S.SAMPLES[lang].items()}, S.OTHER_SAMPLE[lang].replace("'", "''"), "type")
    parts = [_per_field(f"'      ' || name || ': ' || {value('typescript')} || ',' || {_NL}", "ts"), _per_field(f"'        ' || name || '=' || {value('python')} || ',' || {_NL}", "py"), _per_field(f"'        ' || {_pascal('name')} || ': ' || {value('go')} || ',' || {_NL}", "gof")]
    p = _pascal("e.id")
    of = lambda lang, path, content, body: f"SELECT e.doc, '{lang}' AS language, {path} AS path, {content} AS content FROM ent e JOIN {body} b USING (doc, ord)"
    files = [
        of("typescript", "'tests/' || e.id || '.test.ts'", f"'import {{ ' || {p} || {_q(chr(32) + '} from ' + chr(39) + '../types' + chr(39) + ';' + chr(10) + chr(10) + 'describe(' + chr(39))} || {p} || {_q(chr(39) + ', () => {' + chr(10) + '  it(' + chr(39) + 'should create valid entity' + chr(39) + ', () => {' + chr(10) + '    const entity: ')} || {p} || {_q(' = {' + chr(10))} || body || {_q('    };' + chr(10) + '    expect(entity).toBeDefined();' + chr(10) + '  });' + chr(10) + '});' + chr(10))}".replace("{{", "{"), "ts"),
        of("python", "'tests/test_' || e.id || '.py'", f"{_q('import pytest' + chr(10) + 'from ..models import ')} || {p} || {_q(chr(10) + chr(10) + 'def test_')} || e.id || {_q('():' + chr(10) + '    entity = ')} || {p} || {_q('(' + chr(10))} || body || {_q('    )' + chr(10) + '    assert entity is not None' + chr(10))}", "py"),
        of("go", "e.id || '_test.go'", f"{_q('package main' + chr(10) + chr(10) + 'import (' + chr(10) + '    ' + chr(34) + 'testing' + chr(34) + chr(10) + ')' + chr(10) + chr(10) + 'func Test')} || {p} || {_q('(t *testing.T) {' + chr(10) + '    entity := ')} || {p} || {_q(' {' + chr(10))} || body || {_q('    }' + chr(10) + '    if entity == (struct{}) {' + chr(10) + '        t.Error(' + chr(34) + 'Entity should not be empty' + chr(34) + ')' + chr(10) + '    }' + chr(10) + '}' + chr(10))}", "gof"),
    ]
    step = lambda phase, text: f"'      // {phase}: ' || {text} || {_NL}"
    scenario = f"""'  describe(''Scenario: ' || title || ''', () => {{' || {_NL} || '    it(''should pass scenario steps'', async () => {{' || {_NL} || {step('Given', "'given ' || title")} || {step('Given', "'ready'")} || {step('When', "'done'")} || {step('Then', "'then ' || id")} || {_q('      // TODO: Implement actual test steps' + chr(10) + '      expect(true).toBe(true);' + chr(10) + '    });' + chr(10) + '  });' + chr(10))}""".replace("{{", "{")
    feature = f"SELECT f.doc, 'typescript', 'tests/' || f.id || '.feature.test.ts', {_q('import request from ' + chr(39) + 'supertest' + chr(39) + ';' + chr(10) + 'import app from ' + chr(39) + '../app' + chr(39) + ';' + chr(10) + chr(10) + 'describe(' + chr(39) + 'Feature: ')} || f.title || {_q(chr(39) + ', () => {' + chr(10))} || b.body || {_q('});' + chr(10))} FROM feat f JOIN (SELECT doc, ord, string_agg({scenario}, '' ORDER BY sub) AS body FROM scen GROUP BY doc, ord) b USING (doc, ord)"
    return f"{_WITH}, {', '.join(parts)} {' UNION ALL '.join([*files, feature])}"


def _migration(rest: str) -> str:
    """Sets: what stays of the original elements, then what is added. Documents whose batch fails stay as they were."""
    k = "CAST(s_suppkey AS STRING)"
    return f"""{_OPS}, s AS (SELECT n_name AS doc, s_suppkey AS k, s_name AS name, n_nationkey % 10 = 9 AS fails FROM supplier JOIN nation ON s_nationkey = n_nationkey), five AS (SELECT doc, fails, i FROM (SELECT DISTINCT doc, fails FROM s) CROSS JOIN range(5) t(i)),
        ent AS (SELECT doc, 0 AS part, k AS place, 'e' || k AS id, CASE WHEN k % 13 = 4 AND NOT fails THEN (SELECT o.name FROM o WHERE o.k = s.k) ELSE name END AS label, 2 + CASE WHEN fails THEN 0 WHEN k % 13 = 9 THEN 1 WHEN k % 13 = 10 THEN -1 ELSE 0 END AS n_parts, fails, k FROM s WHERE fails OR k % 13 <> 3
            UNION ALL SELECT doc, 1, k, id, name, 0, fails, k FROM o WHERE type = 'add_entity' AND NOT fails),
        feat AS (SELECT doc, 0 AS part, i AS place, 'f' || i AS id, 'F' || i AS label, 0 AS n_parts FROM five f WHERE fails OR NOT EXISTS (SELECT 1 FROM o WHERE o.doc = f.doc AND o.type = 'remove_feature' AND o.id = 'f' || f.i) UNION ALL SELECT doc, 1, k, id, name, 2 FROM o WHERE type = 'add_feature' AND NOT fails),
        act AS (SELECT doc, 0 AS part, k AS place, 'a' || k AS id, CASE WHEN k % 13 = 11 AND NOT fails THEN (SELECT o.name FROM o WHERE o.k = s.k) ELSE name END AS label, 0 AS n_parts FROM s WHERE fails OR k % 13 <> 6 UNION ALL SELECT doc, 1, k, id, name, 0 FROM o WHERE type = 'add_action' AND NOT fails),
        cons AS (SELECT doc, 0 AS part, i AS place, 'c' || i AS id, 'x' AS label, 0 AS n_parts FROM five f WHERE fails OR NOT EXISTS (SELECT 1 FROM o WHERE o.doc = f.doc AND o.type = 'remove_constraint' AND o.id = 'c' || f.i) UNION ALL SELECT doc, 1, k, id, 'x > 0', 0 FROM o WHERE type = 'add_constraint' AND NOT fails)
        {rest}"""  # noqa: F841


_ORD = "CAST(row_number() OVER (PARTITION BY doc ORDER BY part, place) - 1 AS INT)"
_M = f"WITH m AS MATERIALIZED ({MIGRATIONS.format(**_PLAIN)}), applied AS (SELECT CAST(k AS INT) AS ord, id FROM m WHERE applied UNION ALL SELECT 99, 'm99')"


def _operation_error() -> str:
    """Names are blank for every fourth supplier; no other text is."""
    said = {"add_feature": "AddFeature operation requires non-empty id and title", "add_entity": "AddEntity operation requires non-empty id and name", "add_action": "AddAction operation requires non-empty id and name", "add_constraint": "AddConstraint operation requires non-empty id, name, condition, and applies_to"}
    return f"{_OPS} SELECT seq, type, CASE WHEN k % 4 = 0 THEN {_case(said, '', 'type')} ELSE '' END AS error FROM o"


def _operation_line() -> str:
    changed = f"|| {_NL} || '      - Change name to: ' || name"
    lines = {
        "add_feature": "'    + Add feature: ' || id || ' (' || name || ')'", "remove_feature": "'    - Remove feature: ' || id", "add_entity": "'    + Add entity: ' || id || ' (' || name || ')'", "remove_entity": "'    - Remove entity: ' || id",
        "modify_entity": f"'    ~ Modify entity: ' || id {changed}", "add_action": "'    + Add action: ' || id || ' (' || name || ')'", "remove_action": "'    - Remove action: ' || id",
        "add_constraint": "'    + Add constraint: ' || id || ' (' || name || ') - x > 0 applies to ' || target", "remove_constraint": "'    - Remove constraint: ' || id", "add_field": "'    + Add field ''extra'' (int) to entity ''' || target || ''''",
        "remove_field": "'    - Remove field ''note'' from entity ''' || target || ''''", "update_action": f"'    ~ Update action: ' || id {changed}", "change_validation": "'    ~ Change validation for ' || target || ' (entity)'",
    }
    return f"{_OPS} SELECT seq, type, CASE type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in lines.items()) + " END AS line FROM o"


def oracle_sql() -> dict[str, str]:
    edges = "edges AS (SELECT doc, src, dst, relation FROM link UNION ALL SELECT doc, id, needs, 'depends_on' FROM feat)"
    problem = lambda where, text: f"SELECT doc, src AS source, dst AS target, relation, '{text}' AS problem FROM link WHERE {where}"
    kinds = {"entities": "ent", "features": "feat", "actions": "act", "constraints": "cons"}
    return {
        "spec_validation": f"{_validation()} SELECT * FROM found",
        "spec_report": f"{_validation()} SELECT doc, count(message) = 0 AS valid, count(message) AS error_count, coalesce(string_agg(message, {_NL} ORDER BY rule, section, ord, sub, \"check\", message), '') AS errors FROM (SELECT DISTINCT doc FROM feat) LEFT JOIN found USING (doc) GROUP BY doc",
        "spec_listing": f"{_WITH} SELECT doc, 'entities' AS kind, ord, id, name AS label, 3 AS count, '' AS rule_text FROM ent UNION ALL SELECT doc, 'features', ord, id, title, 2, '' FROM feat UNION ALL SELECT doc, 'actions', ord, id, id, 0, '' FROM act UNION ALL SELECT doc, 'constraints', ord, id, name, 0, rule FROM cons",
        "spec_steps": f"{_WITH} SELECT doc, feature, id AS scenario, ord, sub, phase, n, text FROM scen, LATERAL (VALUES ('given', 0, 'given ' || title), ('given', 1, 'ready'), ('when', 0, 'done'), ('then', 0, 'then ' || id)) v(phase, n, text)",
        "spec_render": _render(),
        "spec_tests": _tests(),
        "spec_links": f"{_IDS} " + " UNION ALL ".join([problem("(doc, src) NOT IN (SELECT doc, id FROM ids)", "unknown ''from''"), problem("(doc, dst) NOT IN (SELECT doc, id FROM ids)", "unknown ''to''"), problem("relation NOT IN (" + ", ".join(f"'{r}'" for r in trace.RELATIONS) + ")", "unknown relation"), "SELECT doc, src, dst, relation, 'repeated link' FROM link GROUP BY ALL HAVING count(*) > 1"]),
        # features implement actions: neither end fits, wherever it is known; of several kinds the first in the alphabet counts
        "spec_link_forms": f"{_IDS}, kinds AS (SELECT doc, id, min(CASE section WHEN 0 THEN 'entity' WHEN 1 THEN CASE sub WHEN -1 THEN 'feature' ELSE 'scenario' END WHEN 2 THEN 'action' WHEN 3 THEN 'flow' ELSE 'constraint' END) AS kind FROM ids WHERE id <> '' GROUP BY ALL) SELECT doc, src AS source, dst AS target, relation, '''to'' is no identifier' AS problem FROM link WHERE dst = '' UNION ALL SELECT doc, src, dst, relation, 'implements does not fit to ' || kind FROM link JOIN kinds USING (doc) WHERE kinds.id = dst AND relation = 'implements' AND kind NOT IN ('feature', 'scenario', 'constraint') UNION ALL SELECT doc, src, dst, relation, 'implements does not fit from ' || kind FROM link JOIN kinds USING (doc) WHERE kinds.id = src AND relation = 'implements' AND kind NOT IN ('action', 'flow', 'feature')",
        "spec_graph": f"""{_WITH}, {edges} SELECT doc, 'digraph trace {{' || {_NL} || string_agg(line, '' ORDER BY line) || '}}' || {_NL} AS dot FROM (SELECT doc, '  "' || src || '" -> "' || dst || '" [label="' || relation || '"];' || {_NL} AS line FROM edges) GROUP BY doc""",
        "spec_matrix": f"{_WITH}, {edges} SELECT doc, src AS source, string_agg(dst || ' ' || relation, {_NL} ORDER BY dst, relation) AS cells FROM edges GROUP BY ALL",
        "spec_coverage": f"{_IDS}, {edges}, a AS (SELECT DISTINCT doc, id FROM ids), b AS (SELECT doc, src AS id FROM edges UNION SELECT doc, dst FROM edges) SELECT count(*) FILTER (a.id IS NOT NULL AND b.id IS NOT NULL) AS linked, count(*) FILTER (b.id IS NULL) AS left_orphans, count(*) FILTER (a.id IS NULL) AS right_orphans, count(*) FILTER (a.id IS NOT NULL AND b.id IS NOT NULL) / count(a.id) AS coverage FROM a FULL JOIN b ON a.doc = b.doc AND a.id = b.id",
        # the features of a document lead to the next one in a ring; one that needs another thing, or has no id, breaks it
        "spec_cycles": f"{_WITH} SELECT doc, 'f0' AS node, 'f0 -> f1 -> f2 -> f3 -> f4 -> f0' AS path FROM feat GROUP BY doc HAVING bool_and(id <> '' AND needs <> 'gone')",
        "spec_migration": _migration(" UNION ALL ".join(f"SELECT doc, '{kind}' AS kind, {_ORD} AS ord, id, label, n_parts FROM {t}" for kind, t in kinds.items())),
        "spec_migration_fields": _migration(f", own AS (SELECT doc, part, id AS entity, {_ORD} AS ord, fails, k FROM ent), f AS (SELECT doc, entity, ord, 0 AS sub, 'id' AS name, 'int' AS type, '' AS fallback FROM own WHERE part = 0 UNION ALL SELECT doc, entity, ord, 1, 'note', 'string', '' FROM own WHERE part = 0 AND (fails OR k % 13 <> 10) UNION ALL SELECT doc, entity, ord, 2, 'extra', 'int', '7.0' FROM own WHERE part = 0 AND NOT fails AND k % 13 = 9) SELECT * FROM f"),
        "spec_migration_errors": f"{_OPS} SELECT DISTINCT doc, CASE WHEN fails THEN 'Entity ''nobody'' not found' ELSE '' END AS error FROM o",
        "operation_checks": _operation_error(),
        "operation_lines": _operation_line(),
        "migration_status": f"{_M} SELECT (SELECT count(*) FROM m) AS total, (SELECT count(*) FROM applied) AS applied_count, (SELECT count(*) FROM m WHERE NOT applied) AS pending_count, (SELECT string_agg(id, ' ' ORDER BY ord) FROM applied) AS applied, (SELECT string_agg(id, ' ' ORDER BY id) FROM m WHERE NOT applied) AS pending",
        "migration_order": f"{_M} SELECT row_number() OVER (ORDER BY id) - 1 AS place, id FROM m WHERE NOT applied",
        "migration_rollback": f"{_M}, took AS (SELECT * FROM applied ORDER BY ord DESC LIMIT 12) SELECT ord, id, '' AS error FROM took UNION ALL SELECT ord, id, CASE WHEN m.id IS NULL THEN 'Migration ''' || t.id || ''' not found' WHEN no_down THEN 'Migration ''' || t.id || ''' has no down operations' ELSE 'RemoveEntity operation requires non-empty id' END FROM took t LEFT JOIN m USING (id) WHERE m.id IS NULL OR no_down OR bad_down",
    }
