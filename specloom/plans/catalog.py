"""Flat views of documents: one row for each element, with its place (section, ord, sub)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import SECTIONS


class Catalog:
    """Views over (doc, document). Section numbers follow the order in which rules visit sections."""

    def __init__(self, docs: DataFrame) -> None:
        self.docs = docs.where("document is not null").select("doc", "document.*")

    def section(self, name: str) -> DataFrame:
        """(doc, section, ord, e): the elements of a section."""
        return self.docs.select("doc", F.lit(SECTIONS.index(name)).alias("section"), F.posexplode(name).alias("ord", "e"))

    def fields(self) -> DataFrame:
        rows = self.section("entities").select("doc", "section", "ord", F.col("e.id").alias("entity"), F.posexplode("e.fields").alias("sub", "f"))
        return rows.select("doc", "section", "ord", "entity", "sub", F.col("f.name").alias("name"), F.col("f.type").alias("type"), F.col("f.required").alias("required"), F.col("f.default").alias("default"), F.col("f.constraints").alias("constraints"), F.col("f.description").alias("description"))

    def scenarios(self) -> DataFrame:
        rows = self.section("features").select("doc", "section", "ord", F.col("e.id").alias("feature"), F.posexplode("e.scenarios").alias("sub", "s"))
        return rows.select("doc", "section", "ord", "feature", "sub", F.col("s.id").alias("id"), F.col("s.title").alias("title"), F.struct("s.given", "s.when", "s.then").alias("steps"))

    def steps(self) -> DataFrame:
        """(doc, feature, scenario, ord, sub, phase, n, text) of every given, when and then."""
        parts = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(p).alias("phase"), F.col(f"steps.{p}").alias("texts")) for k, p in enumerate(("given", "when", "then"))))
        rows = self.scenarios().select("doc", "feature", F.col("id").alias("scenario"), "ord", "sub", F.inline(parts))
        return rows.select("doc", "feature", "scenario", "ord", "sub", "k", "phase", F.posexplode("texts").alias("n", "text"))

    def ids(self) -> DataFrame:
        """(doc, section, ord, sub, kind, id): the shared namespace, in one pass over the documents. A feature comes before its scenarios (sub -1)."""
        row = lambda section, ord_, sub, kind, id_: F.struct(F.lit(SECTIONS.index(section)).alias("section"), ord_.alias("ord"), sub.alias("sub"), F.lit(kind).alias("kind"), id_.alias("id"))
        all_of = lambda section, kind: F.transform(section, lambda e, i: row(section, i, F.lit(-1), kind, e["id"]))
        own = [all_of(section, kind) for section, kind in (("entities", "entity"), ("features", "feature"), ("actions", "action"), ("flows", "flow"), ("constraints", "constraint"))]
        scenarios = F.flatten(F.transform("features", lambda f, i: F.transform(f["scenarios"], lambda s, j: row("features", i, j, "scenario", s["id"]))))
        return self.docs.select("doc", F.inline(F.concat(*own, scenarios)))

    def references(self) -> DataFrame:
        """(doc, section, ord, sub, check, kind, from, to): feature dependencies and both ends of trace links, each with the id that must exist as ``to``."""
        row = lambda section, i, j, check, kind, a, b: F.struct(F.lit(SECTIONS.index(section)).alias("section"), i.alias("ord"), j.alias("sub"), F.lit(check).alias("check"), F.lit(kind).alias("kind"), a.alias("from"), b.alias("to"))
        needs = F.transform("features", lambda f, i: F.transform(F.coalesce(f["dependencies"], F.array().cast("array<string>")), lambda d, j: row("features", i, j, 0, "dependency", f["id"], d)))
        ends = F.transform("traceability", lambda t, i: F.array(row("traceability", i, F.lit(-1), 0, "from", t["to"], t["from"]), row("traceability", i, F.lit(-1), 1, "to", t["from"], t["to"])))
        return self.docs.select("doc", F.inline(F.flatten(F.concat(needs, ends))))

    def dependencies(self) -> DataFrame:
        return self.section("features").select("doc", "section", "ord", F.col("e.id").alias("from"), F.posexplode("e.dependencies").alias("sub", "to"))

    def trace(self) -> DataFrame:
        return self.section("traceability").select("doc", "section", "ord", "e.from", "e.to", "e.relation", "e.description")

    def edges(self) -> DataFrame:
        """(doc, from, to, relation): trace links and feature dependencies."""
        return self.trace().select("doc", "from", "to", "relation").unionByName(self.dependencies().select("doc", "from", "to", F.lit("depends_on").alias("relation")))
