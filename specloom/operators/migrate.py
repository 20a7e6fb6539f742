"""Migrations: an ordered log of operations on a document.

The log is small and its order is sequential by nature: the first operation that fails stops the batch and nothing is saved. One document is therefore folded on the
driver (``fold``); a corpus is folded with one task for each document (``replay_corpus``). The parts that are sets (what is pending, the order by dependencies, status,
what rollback takes) are relational plans over ids. Where the original order among independent migrations is open, ids are taken in sorted order.
"""

from __future__ import annotations

import copy
import json
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import is_blank
from ..shipping import ship


class MigrationError(Exception):
    pass


#: The texts an operation needs, by its type, and how its error names them. Other operations need none.
NEEDS = {
    "add_feature": (("id", "title"), "AddFeature operation requires non-empty id and title"),
    "remove_feature": (("id",), "RemoveFeature operation requires non-empty id"),
    "add_entity": (("id", "name"), "AddEntity operation requires non-empty id and name"),
    "remove_entity": (("id",), "RemoveEntity operation requires non-empty id"),
    "add_action": (("id", "name"), "AddAction operation requires non-empty id and name"),
    "remove_action": (("id",), "RemoveAction operation requires non-empty id"),
    "add_constraint": (("id", "name", "condition", "applies_to"), "AddConstraint operation requires non-empty id, name, condition, and applies_to"),
    "remove_constraint": (("id",), "RemoveConstraint operation requires non-empty id"),
    "add_field": (("entity_id", "field_name", "field_type"), "AddField operation requires non-empty entity_id, field_name, and field_type"),
    "remove_field": (("entity_id", "field_name"), "RemoveField operation requires non-empty entity_id and field_name"),
}
#: One line for each operation in a dry run.
SAYS = {
    "add_feature": "    + Add feature: {id} ({title})", "remove_feature": "    - Remove feature: {id}", "add_entity": "    + Add entity: {id} ({name})", "remove_entity": "    - Remove entity: {id}",
    "modify_entity": "    ~ Modify entity: {id}", "add_action": "    + Add action: {id} ({name})", "remove_action": "    - Remove action: {id}",
    "add_constraint": "    + Add constraint: {id} ({name}) - {condition} applies to {applies_to}", "remove_constraint": "    - Remove constraint: {id}",
    "add_field": "    + Add field '{field_name}' ({field_type}) to entity '{entity_id}'", "remove_field": "    - Remove field '{field_name}' from entity '{entity_id}'",
    "update_action": "    ~ Update action: {id}", "change_validation": "    ~ Change validation for {target_id} ({target_type})",
}


def operation_errors() -> Column:
    """Over operation columns: what is wrong with the operation's own texts, null if nothing."""
    out = F.lit(None).cast("string")
    for kind, (parts, message) in NEEDS.items():
        bad = is_blank(F.col(parts[0]))
        for p in parts[1:]:
            bad = bad | is_blank(F.col(p))
        out = F.when((F.col("type") == kind) & bad, message).otherwise(out)
    return out


def describe() -> Column:
    """Over operation columns: the dry-run line."""
    out = F.lit(None).cast("string")
    for kind, text in SAYS.items():
        pieces = []
        for k, part in enumerate(text.replace("}", "{").split("{")):
            pieces.append(F.coalesce(F.col(part), F.lit("")) if k % 2 else F.lit(part))
        line = F.concat(*pieces)
        if kind in ("modify_entity", "update_action"):
            line = F.concat(line, F.when(F.col("new_name").isNotNull(), F.concat(F.lit("\n      - Change name to: "), "new_name")).otherwise(""))
        out = F.when(F.col("type") == kind, line).otherwise(out)
    return out


def check_operation(op: dict) -> None:
    parts, message = NEEDS.get(op.get("type"), ((), ""))
    if any(not (op.get(p) or "").strip() for p in parts):
        raise MigrationError(message)


def pending(migrations: DataFrame, applied: DataFrame) -> DataFrame:
    """Ids of ``migrations`` that ``applied`` (id) lacks."""
    return migrations.select("id").join(applied.select("id"), "id", "left_anti")


def dependencies(migrations: DataFrame) -> DataFrame:
    return migrations.select("id", F.explode("migration.dependencies").alias("needs"))


def ordered(ids: set[str], needs: dict[str, list[str]], todo: set[str]) -> list[str]:
    """``todo`` with every migration after those it needs; unknown ones are ignored. A cycle anywhere on the way is an error."""
    out: list[str] = []
    state: dict[str, int] = {}
    for start in sorted(todo):
        stack = [(start, iter(sorted(needs.get(start, ()))))] if start not in state else []
        if stack:
            state[start] = 1
        while stack:
            at, rest = stack[-1]
            for n in rest:
                if n not in ids or state.get(n) == 2:
                    continue
                if state.get(n) == 1:
                    raise MigrationError(f"Circular dependency detected involving migration '{n}'")
                state[n] = 1
                stack.append((n, iter(sorted(needs.get(n, ())))))
                break
            else:
                state[at] = 2
                out.append(at)
                stack.pop()
    return [x for x in out if x in todo]


def plan(migrations: DataFrame, applied: DataFrame) -> list[str]:
    """Pending ids in dependency order. What comes to the driver is ids and edges of one project's migrations."""
    todo = {r.id for r in pending(migrations, applied).collect()}
    needs: dict[str, list[str]] = {}
    for r in dependencies(migrations).collect():
        needs.setdefault(r.id, []).append(r.needs)
    return ordered({r.id for r in migrations.select("id").collect()}, needs, todo)


def status(migrations: DataFrame, applied: DataFrame) -> DataFrame:
    """One row: total, applied and pending counts and ids. Applied counts state ids even if their file is gone."""
    a = applied.agg(F.count(F.lit(1)).alias("applied_count"), F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"]).alias("applied"))
    p = pending(migrations, applied).agg(F.count(F.lit(1)).alias("pending_count"), F.array_sort(F.collect_list("id")).alias("pending"))
    t = migrations.agg(F.count(F.lit(1)).alias("total"))
    return t.join(a, F.lit(True)).join(p, F.lit(True))


def rollback_plan(applied: DataFrame, n: int) -> DataFrame:
    """The last n of (ord, id), newest first."""
    return applied.orderBy(F.col("ord").desc()).limit(n)


def rollback_errors(applied: DataFrame, migrations: DataFrame, n: int) -> DataFrame:
    """(ord, id, error) of migrations that cannot be rolled back: no file, no down operations, or a bad one."""
    rows = rollback_plan(applied, n).join(migrations, "id", "left")
    base = F.when(F.col("migration").isNull(), F.concat(F.lit("Migration '"), "id", F.lit("' not found"))).when(F.coalesce(F.size("migration.down"), F.lit(0)) <= 0, F.concat(F.lit("Migration '"), "id", F.lit("' has no down operations")))
    own = rows.select("ord", "id", base.alias("error")).where("error is not null")
    ops = rows.where("migration is not null").select("ord", F.col("id").alias("mid"), F.explode("migration.down").alias("o")).select("ord", "mid", "o.*")
    return own.unionByName(ops.select("ord", F.col("mid").alias("id"), operation_errors().alias("error")).where("error is not null"))


# --- replay ---------------------------------------------------------------------------------------------------------


def _first(rows: list[dict], key: str, kind: str) -> dict:
    for r in rows:
        if r["id"] == key:
            return r
    raise MigrationError(f"{kind} '{key}' not found")


def _value(text: str | None):
    """A default as stored: strings, numbers (doubles) and booleans; lists and objects become the string null."""
    if text is None:
        return None
    v = json.loads(text)
    return json.dumps(v if isinstance(v, (str, bool)) else float(v) if isinstance(v, (int, float)) else "null")


def _add_feature(doc: dict, op: dict) -> None:
    # The steps of a scenario that only has a title.
    steps = {"given": ["System is ready"], "when": ["User performs action"], "then": ["Expected outcome occurs"]}
    scenarios = [{"id": f"{op['id']}_scenario_{k}", "title": t, "description": None} | copy.deepcopy(steps) for k, t in enumerate(op.get("scenarios") or (), 1)]
    doc["features"].append({"id": op["id"], "title": op["title"], "description": op.get("description"), "scenarios": scenarios, "acceptance_criteria": None, "dependencies": None})


def _add_entity(doc: dict, op: dict) -> None:
    doc["entities"].append({"id": op["id"], "name": op["name"], "description": op.get("description"), "fields": [], "relationships": None})


def _add_action(doc: dict, op: dict) -> None:
    doc["actions"].append({"id": op["id"], "name": op["name"], "description": op.get("description"), "input": None, "output": None, "side_effects": None, "preconditions": None, "postconditions": None})


def _add_constraint(doc: dict, op: dict) -> None:
    doc["constraints"].append({"id": op["id"], "name": op["name"], "description": op.get("description"), "type": "rule", "rule": op["condition"], "entities": None, "actions": None})


def _remove(section: str):
    def run(doc: dict, op: dict) -> None:
        doc[section] = [r for r in doc[section] if r["id"] != op["id"]]

    return run


def _modify(section: str, kind: str):
    def run(doc: dict, op: dict) -> None:
        row = _first(doc[section], op["id"], kind)
        for key, new in (("name", op.get("new_name")), ("description", op.get("new_description"))):
            if new is not None:
                row[key] = new

    return run


def _add_field(doc: dict, op: dict) -> None:
    _first(doc["entities"], op["entity_id"], "Entity")["fields"].append(
        {"name": op["field_name"], "type": op["field_type"], "description": "Field added by migration", "required": op.get("required"), "default": _value(op.get("default")), "constraints": None}
    )


def _remove_field(doc: dict, op: dict) -> None:
    entity = _first(doc["entities"], op["entity_id"], "Entity")
    kept = [f for f in entity["fields"] if f["name"] != op["field_name"]]
    if len(kept) == len(entity["fields"]):
        raise MigrationError(f"Field '{op['field_name']}' not found in entity '{op['entity_id']}'")
    entity["fields"] = kept


def _change_validation(doc: dict, op: dict) -> None:
    """Only looks for its target: the rules it carries change nothing."""
    kinds = {"entity": ("entities", "Entity"), "action": ("actions", "Action")}
    if op.get("target_type") not in kinds:
        raise MigrationError(f"Unsupported target type for validation: {op.get('target_type')}")
    section, kind = kinds[op["target_type"]]
    _first(doc[section], op["target_id"], kind)


EXECUTE = {
    "add_feature": _add_feature, "remove_feature": _remove("features"), "add_entity": _add_entity, "remove_entity": _remove("entities"), "modify_entity": _modify("entities", "Entity"),
    "add_action": _add_action, "remove_action": _remove("actions"), "add_constraint": _add_constraint, "remove_constraint": _remove("constraints"), "add_field": _add_field,
    "remove_field": _remove_field, "update_action": _modify("actions", "Action"), "change_validation": _change_validation,
}


def _link(op: dict) -> tuple:
    return op.get("from"), op.get("to")


def _add_link(doc: dict, op: dict) -> None:
    doc["traceability"].append({"from": op["from"], "to": op["to"], "relation": op["relation"], "description": op.get("description")})


def _remove_link(doc: dict, op: dict) -> None:
    doc["traceability"] = [t for t in doc["traceability"] if (t["from"], t["to"]) != _link(op)]


def _update_link(doc: dict, op: dict) -> None:
    found = [t for t in doc["traceability"] if (t["from"], t["to"]) == _link(op)]
    if not found:
        raise MigrationError(f"Link '{op.get('from')}' -> '{op.get('to')}' not found")
    for t in found:
        t["relation"] = op.get("relation") or t["relation"]


def _modify_feature(doc: dict, op: dict) -> None:
    row = _first(doc["features"], op["id"], "Feature")
    for key, new in (("title", op.get("new_name")), ("description", op.get("new_description"))):
        if new is not None:
            row[key] = new


#: Operations that the language describes beyond those that migration files could hold so far; ``fold`` takes them only if asked.
EXTENDED = EXECUTE | {
    "modify_feature": _modify_feature, "modify_action": _modify("actions", "Action"), "modify_constraint": _modify("constraints", "Constraint"),
    "add_traceability_link": _add_link, "remove_traceability_link": _remove_link, "update_traceability_link": _update_link,
}


def fold(document: dict, operations: list[dict], extended: bool = False) -> dict:
    """The document after all operations; the first that fails raises, and the given document is never changed."""
    doc, known = copy.deepcopy(document), EXTENDED if extended else EXECUTE
    for op in operations:
        if op.get("type") not in known:
            raise MigrationError(f"unknown operation `{op.get('type')}`")
        known[op["type"]](doc, op)
    return doc


def replay_corpus(docs: DataFrame, operations: DataFrame) -> DataFrame:
    """(doc, error, document) after the operations (doc, seq, op) of each document, in order of seq; a failing batch leaves its document as it was.

    A document with its log is one row, so documents are folded in parallel and none is gathered with another.
    """
    log = operations.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.to_json("op").alias("op")))), lambda x: x["op"]).alias("ops"))
    rows = docs.where("document is not null").join(log, "doc", "left").select("doc", F.to_json("document", {"ignoreNullFields": "false"}).alias("json"), "ops")
    kind = docs.schema["document"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, errors = [], []
            for text, ops in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                try:
                    out.append(json.dumps(fold(json.loads(text), [json.loads(o) for o in ops or ()])))
                    errors.append(None)
                except MigrationError as e:
                    out.append(text)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(errors, pa.string()), pa.array(out, pa.string())], ["doc", "error", "json"])

    ship(docs.sparkSession)
    return rows.mapInArrow(run, "doc string, error string, json string").select("doc", "error", F.from_json("json", kind).alias("document"))


# --- state ----------------------------------------------------------------------------------------------------------


def empty_state(now: str) -> dict:
    return {"applied_migrations": [], "last_migration": None, "created_at": now, "updated_at": now}


def read_state(spark: SparkSession, path: str, now: str | None = None) -> dict:
    """The state file; a missing or broken one is an empty state."""
    now = now or datetime.now(UTC).isoformat()
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)  # by the file system, since Spark's readers skip names that begin with a dot
    try:
        stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
        try:
            state = json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return {k: state[k] for k in ("applied_migrations", "created_at", "updated_at")} | {"last_migration": state.get("last_migration")}
    except Exception:
        return empty_state(now)


def applied_frame(spark: SparkSession, state: dict) -> DataFrame:
    return spark.createDataFrame(list(enumerate(state["applied_migrations"])), "ord int, id string")


def with_applied(state: dict, ids: list[str], now: str) -> dict:
    done = state["applied_migrations"] + [i for i in dict.fromkeys(ids) if i not in set(state["applied_migrations"])]
    return state | {"applied_migrations": done, "last_migration": ids[-1] if ids else state["last_migration"], "updated_at": now}


def without_applied(state: dict, ids: list[str], now: str) -> dict:
    left = [i for i in state["applied_migrations"] if i not in set(ids)]
    return state | {"applied_migrations": left, "last_migration": left[-1] if left else None, "updated_at": now}

