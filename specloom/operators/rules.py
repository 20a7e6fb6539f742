"""Integrity rules: each maps a catalog to (doc, rule, section, ord, sub, check, message). Their union, ordered by these places, is the report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import SECTIONS
from ..plans.catalog import Catalog
from .relational import dangling, union_all

COLUMNS = ["doc", "rule", "section", "ord", "sub", "check", "message"]
Rule = Callable[[Catalog], DataFrame]


def _bad(section: str, items: Column, broken: Callable[[Column], Column], check: int, message: Callable[[Column, Column], Column], parent: tuple[Column, Column] | None = None) -> Column:
    """An array of findings on the elements of an array; with ``parent`` (its place and itself) the elements are the parent's."""
    numbered = F.transform(items, lambda e, i: F.struct(i.alias("i"), e.alias("e")))
    place = (lambda i: (parent[0], i)) if parent else (lambda i: (i, F.lit(-1)))
    found = lambda x: F.struct(F.lit(SECTIONS.index(section)).alias("section"), place(x["i"])[0].alias("ord"), place(x["i"])[1].alias("sub"), F.lit(check).alias("check"), message(x["e"], x["i"]).alias("message"))
    return F.transform(F.filter(numbered, lambda x: broken(x["e"])), found)


def _rows(c: Catalog, rule: int, findings: list[Column]) -> DataFrame:
    """One pass over the documents, without a shuffle."""
    return c.docs.select("doc", F.lit(rule).alias("rule"), F.inline(F.concat(*findings)))


def required_ids(c: Catalog) -> DataFrame:
    """Empty ids, titles, names and rules."""
    out = []
    for section, kind in (("entities", "Entity"), ("features", "Feature"), ("actions", "Action"), ("flows", "Flow"), ("constraints", "Constraint")):
        items = F.col(section)
        out.append(_bad(section, items, lambda e: e["id"] == "", 0, lambda e, i, k=kind: F.format_string(f"{k} at index %d is missing required 'id' field", i)))
        for n, part in enumerate({"features": ["title"], "flows": ["name"], "constraints": ["name", "rule"]}.get(section, []), 1):
            out.append(_bad(section, items, lambda e, p=part: e[p] == "", n, lambda e, i, k=kind, p=part: F.format_string(f"{k} '%s' is missing required '{p}' field", e["id"])))

    def scenarios(f: Column, i: Column) -> Column:
        no_id = _bad("features", f["scenarios"], lambda s: s["id"] == "", 0, lambda s, j: F.format_string("Scenario at index %d in feature '%s' is missing required 'id' field", j, f["id"]), (i, f))
        no_title = _bad("features", f["scenarios"], lambda s: s["title"] == "", 1, lambda s, j: F.format_string("Scenario '%s' in feature '%s' is missing required 'title' field", s["id"], f["id"]), (i, f))
        return F.concat(no_id, no_title)

    return _rows(c, 0, [*out, F.flatten(F.transform("features", scenarios))])


def unique_ids(c: Catalog) -> DataFrame:
    """Ids that occur again anywhere in their document; empty ones do not count."""
    again = F.row_number().over(W.partitionBy("doc", "id").orderBy("section", "ord", "sub"))
    rows = c.ids().where("id <> ''").withColumn("nth", again).where("nth > 1")
    return rows.select("doc", F.lit(1).alias("rule"), "section", "ord", "sub", F.lit(0).alias("check"), F.format_string("Duplicate ID found: '%s'", "id").alias("message"))


def valid_references(c: Catalog) -> DataFrame:
    """Feature dependencies and trace links without a target of any kind."""
    lost = dangling(c.references(), c.ids().select("doc", F.col("id").alias("to")).distinct(), ["doc", "to"])
    said = F.when(F.col("kind") == "dependency", F.format_string("Feature '%s' references unknown dependency: '%s'", "from", "to")).otherwise(F.format_string("Traceability references unknown '%s' element: '%s'", "kind", "to"))
    return lost.select("doc", F.lit(2).alias("rule"), "section", "ord", "sub", "check", said.alias("message"))


def required_fields(c: Catalog) -> DataFrame:
    """Fields without a name or a type."""

    def fields(e: Column, i: Column) -> Column:
        no_name = _bad("entities", e["fields"], lambda f: f["name"] == "", 0, lambda f, j: F.format_string("Field in entity '%s' is missing required 'name'", e["id"]), (i, e))
        no_type = _bad("entities", e["fields"], lambda f: f["type"] == "", 1, lambda f, j: F.format_string("Field '%s' in entity '%s' is missing required 'type'", f["name"], e["id"]), (i, e))
        return F.concat(no_name, no_type)

    return _rows(c, 3, [F.flatten(F.transform("entities", fields))])


RULES: dict[str, Rule] = {"required_ids": required_ids, "unique_ids": unique_ids, "valid_references": valid_references, "required_fields": required_fields}


def validate(docs: DataFrame, rules: dict[str, Rule] | None = None) -> DataFrame:
    """Findings of all rules over a corpus of documents. Sort by COLUMNS for the order of a report."""
    c = Catalog(docs)
    return union_all([r(c) for r in (rules or RULES).values()]).select(*COLUMNS)


def report(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """(doc, valid, error_count, errors) for each readable document, messages in report order."""
    place = F.struct("rule", "section", "ord", "sub", "check", "message")
    per = findings.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["message"]).alias("errors"))
    out = docs.where("document is not null").select("doc").join(per, "doc", "left")
    errors = F.coalesce("errors", F.array().cast("array<string>"))
    return out.select("doc", (F.size(errors) == 0).alias("valid"), F.size(errors).alias("error_count"), errors.alias("errors"))


def report_json(reports: DataFrame) -> DataFrame:
    return reports.select("doc", F.to_json(F.struct("valid", "error_count", "errors"), {"pretty": "true"}).alias("json"))


def report_text(reports: DataFrame, strict: bool = False) -> DataFrame:
    """(doc, text): the lines a person reads; findings are numbered from 1."""
    lines = F.transform("errors", lambda e, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), e))
    head = F.concat(F.lit("Validation failed for " if strict else "Validation warnings for "), "doc")
    tail = F.array() if strict else F.array(F.concat(F.lit("Found "), F.col("error_count").cast("string"), F.lit(" validation warnings")), F.lit("Use --strict flag to treat warnings as errors"))
    bad = F.array_join(F.concat(F.array(head), lines, tail.cast("array<string>")), "\n")
    return reports.select("doc", F.when(F.col("valid"), F.concat(F.lit("✓ "), "doc", F.lit(" is valid"))).otherwise(bad).alias("text"))


class StrictError(Exception):
    pass


def strict_gate(findings: DataFrame) -> None:
    """Raises if there is any finding; reads no more than one."""
    if findings.limit(1).count():
        raise StrictError("Validation failed in strict mode")


def listing(docs: DataFrame, kind: str) -> DataFrame:
    """(doc, ord, id, label, description, count, rule) of features, entities, actions or constraints, in document order."""
    rows, none = Catalog(docs).section(kind), F.lit(None)
    label = {"features": F.col("e.title"), "constraints": F.col("e.name")}.get(kind, F.coalesce("e.name", "e.id"))
    count = {"features": F.size("e.scenarios"), "entities": F.size("e.fields")}.get(kind, none.cast("int"))
    rule = F.col("e.rule") if kind == "constraints" else none.cast("string")
    return rows.select("doc", "ord", F.col("e.id").alias("id"), label.alias("label"), F.col("e.description").alias("description"), F.when(count > 0, count).alias("count"), rule.alias("rule"))


def listing_text(docs: DataFrame, kind: str) -> DataFrame:
    """(doc, text): a header with the total, then the elements."""
    title = kind.capitalize()
    count = {"features": "Scenarios", "entities": "Fields"}.get(kind, "")
    some = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f"\n    {name}: "), c.cast("string"))).otherwise("")
    line = F.concat(F.lit("  • "), "id", F.lit(" - "), F.coalesce("label", F.lit("")), some("Description", F.col("description")), some(count, F.col("count")), some("Rule", F.col("rule")))
    per = listing(docs, kind).groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"]).alias("lines"))
    out = docs.where("document is not null").select("doc").join(per, "doc", "left")
    return out.select("doc", F.when(F.col("lines").isNull(), f"No {kind} found").otherwise(F.concat(F.lit(f"{title} ("), F.size("lines").cast("string"), F.lit("):\n"), F.array_join("lines", "\n"))).alias("text"))
