"""Traceability: edges, cycles, matrix, coverage, link quality, design principles."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import PRINCIPLES
from ..plans.catalog import Catalog
from ..shipping import stored
from .relational import coverage as _coverage
from .relational import union_all

# Names of relations.
RELATIONS = ("implements", "verifies", "tests", "blocks", "depends_on", "represented_by", "calls", "configures")


#: A graph of at most so many edges is walked in one task; the nodes of a larger one are peeled in rounds over stored tables.
ONE_TASK = 100_000


def depths(edges: DataFrame, child: str, parent: str, one_task: int = ONE_TASK) -> DataFrame:
    """(node, depth): the longest way from a node without parents; null on or behind a cycle. Every edge is used once, whatever the number of ways."""
    e = edges.select(F.col(child).alias("c"), F.col(parent).alias("p")).where("c is not null and p is not null").distinct()
    if e.limit(one_task + 1).count() > one_task:
        return _peeled(e)
    kind = dict(e.dtypes)["c"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below, open_, depth = defaultdict(list), Counter(), {}
        for b in batches:
            for c, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                below[p].append(c)
                open_[c] += 1
        free = [p for p in below if p not in open_]
        nodes = set(below) | set(open_)
        depth = dict.fromkeys(free, 0)
        for p in free:  # grows as it is read
            for c in below.get(p, ()):
                depth[c] = max(depth.get(c, 0), depth[p] + 1)
                open_[c] -= 1
                if not open_[c]:
                    free.append(c)
        settled = set(free)
        yield pa.RecordBatch.from_pydict({"node": list(nodes), "depth": pa.array([depth[x] if x in settled else None for x in nodes], pa.int32())})

    return e.coalesce(1).mapInArrow(run, f"node {kind}, depth int")


def _peeled(e: DataFrame) -> DataFrame:
    """Round by round, the nodes whose parents all went before."""
    e = stored(e)
    level = stored(e.select(F.col("p").alias("node")).distinct().join(e.select(F.col("c").alias("node")).distinct(), "node", "left_anti"))
    out, k = [], 0
    while not level.isEmpty():
        out.append(level.withColumn("depth", F.lit(k)))
        rest = stored(e.join(level, e["p"] == level["node"], "left_anti"))
        reached = e.join(level, e["p"] == level["node"], "left_semi").select(F.col("c").alias("node")).distinct()
        level = stored(reached.join(rest.select(F.col("c").alias("node")).distinct(), "node", "left_anti"))
        e, k = rest, k + 1
    return union_all([*out, e.select(F.col("c").alias("node"), F.lit(None).cast("int").alias("depth")).distinct()])


def _parts(edges: dict[str, list[str]]) -> list[list[str]]:
    """Sets of nodes that all reach each other, by one depth-first walk with a stack of its own."""
    number, low, path, on, out = {}, {}, [], set(), []
    for root in edges:
        work = [] if root in number else [(root, iter(edges[root]))]
        if work:
            number[root] = low[root] = len(number)
            path.append(root)
            on.add(root)
        while work:
            at, rest = work[-1]
            for to in rest:
                if to not in number:
                    number[to] = low[to] = len(number)
                    path.append(to)
                    on.add(to)
                    work.append((to, iter(edges.get(to, ()))))
                    break
                if to in on:
                    low[at] = min(low[at], number[to])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[at])
                if low[at] == number[at]:
                    part = []
                    while not part or part[-1] != at:
                        part.append(path.pop())
                        on.discard(part[-1])
                    out.append(part)
    return out


def _shortest(edges: dict[str, list[str]], start: str) -> list[str]:
    """A shortest way from a node back to itself; of several, by the smallest next nodes."""
    came, queue = {}, [start]
    for at in queue:
        for to in sorted(edges.get(at, ())):
            if to == start:
                way = [at]
                while way[-1] != start:
                    way.append(came[way[-1]])
                return [*way[::-1], start]
            if to not in came:
                came[to] = at
                queue.append(to)
    return []


def cycles(edges: DataFrame, source: str = "from", target: str = "to", group: str | None = None) -> DataFrame:
    """(node, path), with ``group`` before: for each set of nodes that all reach each other a shortest cycle through its smallest node, whatever its length.

    A group is one document's graph and is walked in one task; without ``group`` all edges are one graph.
    """
    e = edges.select((F.col(group) if group else F.lit("")).alias("g"), F.col(source).cast("string").alias("s"), F.col(target).cast("string").alias("t")).where("s is not null and t is not null").distinct()

    def run(t: pa.Table) -> pa.Table:
        graph = defaultdict(list)
        for s, to in zip(t.column("s").to_pylist(), t.column("t").to_pylist()):
            graph[s].append(to)
        found = []
        for part in _parts(dict(graph)):
            own = set(part)
            inside = {x: [y for y in graph.get(x, ()) if y in own] for x in part}
            if way := _shortest(inside, min(part)):
                found.append((way[0], " -> ".join(way)))
        return pa.table({"g": pa.array([t.column("g")[0].as_py()] * len(found), t.schema.field("g").type), "node": pa.array([x[0] for x in found], pa.string()), "path": pa.array([x[1] for x in found], pa.string())})

    out = e.groupBy("g").applyInArrow(run, f"g {dict(e.dtypes)['g']}, node string, path string")
    return out.withColumnRenamed("g", group) if group else out.drop("g")


def validate(docs: DataFrame, relations: tuple[str, ...] = RELATIONS) -> DataFrame:
    """(doc, from, to, relation, problem): links without an end, of an unknown relation, or repeated."""
    c = Catalog(docs)
    ids = c.ids().select("doc", "id").distinct()
    edges = c.trace().select("doc", "from", "to", "relation")
    out = [edges.join(ids.withColumnRenamed("id", end), ["doc", end], "left_anti").select("doc", "from", "to", "relation", F.lit(f"unknown '{end}'").alias("problem")) for end in ("from", "to")]
    out.append(edges.where(~F.col("relation").isin(*relations)).withColumn("problem", F.lit("unknown relation")))
    out.append(edges.groupBy("doc", "from", "to", "relation").count().where("count > 1").select("doc", "from", "to", "relation", F.lit("repeated link").alias("problem")))
    return union_all(out)


def graph(docs: DataFrame) -> DataFrame:
    """(doc, dot): the links of each document as a DOT graph."""
    line = F.concat(F.lit('  "'), "from", F.lit('" -> "'), "to", F.lit('" [label="'), "relation", F.lit('"];\n'))
    per = Catalog(docs).edges().groupBy("doc").agg(F.array_join(F.array_sort(F.collect_list(line)), "").alias("lines"))
    return per.select("doc", F.concat(F.lit("digraph trace {\n"), "lines", F.lit("}\n")).alias("dot"))


def matrix(docs: DataFrame) -> DataFrame:
    """(doc, from, links): for each source its targets and relations, as a map; the sparse form of the matrix."""
    cell = F.collect_list(F.struct("to", "relation"))
    return Catalog(docs).edges().groupBy("doc", "from").agg(F.array_sort(cell).alias("links"))


def matrix_text(docs: DataFrame, form: str = "csv") -> DataFrame:
    """(doc, text): the matrix as csv, html or json; a row for each source, a column for each target, relations in the cells."""
    rows = matrix(docs).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("from", "links"))).alias("rows"))
    targets = F.array_sort(F.array_distinct(F.flatten(F.transform("rows", lambda r: F.transform(r["links"], lambda x: x["to"])))))
    rows = rows.withColumn("targets", targets)
    cell = lambda r, t: F.array_join(F.transform(F.filter(r["links"], lambda x: x["to"] == t), lambda x: x["relation"]), " ")
    if form == "json":
        return rows.select("doc", F.to_json(F.transform("rows", lambda r: F.struct(r["from"].alias("from"), r["links"].alias("links")))).alias("text"))
    if form == "csv":
        quoted = lambda x: F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))
        line = lambda head, cells: F.concat(F.array_join(F.concat(F.array(quoted(head)), F.transform(cells, quoted)), ","), F.lit("\n"))
        return rows.select("doc", F.concat(line(F.lit("from"), F.col("targets")), F.array_join(F.transform("rows", lambda r: line(r["from"], F.transform("targets", lambda t: cell(r, t)))), "")).alias("text"))
    if form == "html":
        safe = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
        line = lambda tag, head, cells: F.concat(F.lit("<tr><th>"), safe(head), F.lit("</th>"), F.array_join(F.transform(cells, lambda x: F.concat(F.lit(f"<{tag}>"), safe(x), F.lit(f"</{tag}>"))), ""), F.lit("</tr>\n"))
        return rows.select("doc", F.concat(F.lit("<table>\n"), line("th", F.lit(""), F.col("targets")), F.array_join(F.transform("rows", lambda r: line("td", r["from"], F.transform("targets", lambda t: cell(r, t)))), ""), F.lit("</table>\n")).alias("text"))
    raise ValueError(f"unknown format {form!r}: csv, html or json")


def graph_svg(docs: DataFrame) -> DataFrame:
    """(doc, text): the links as an SVG drawing, sources on the left, targets on the right."""
    per = Catalog(docs).edges().groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("from", "to", "relation"))).alias("e"))
    per = per.withColumn("l", F.array_sort(F.array_distinct(F.transform("e", lambda x: x["from"])))).withColumn("r", F.array_sort(F.array_distinct(F.transform("e", lambda x: x["to"]))))
    safe = lambda x: F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    y = lambda side, x: F.array_position(side, x).cast("int") * 24
    label = lambda side, at, anchor: F.array_join(F.transform(side, lambda x, i: F.concat(F.lit(f'<text x="{at}" y="'), ((i + 1) * 24 + 4).cast("string"), F.lit(f'" text-anchor="{anchor}">'), safe(x), F.lit("</text>\n"))), "")
    line = F.array_join(F.transform("e", lambda x: F.concat(F.lit('<line x1="205" x2="395" y1="'), y(F.col("l"), x["from"]).cast("string"), F.lit('" y2="'), y(F.col("r"), x["to"]).cast("string"), F.lit('" stroke="black"><title>'), safe(x["relation"]), F.lit("</title></line>\n"))), "")
    height = ((F.greatest(F.size("l"), F.size("r")) + 1) * 24).cast("string")
    return per.select("doc", F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" width="600" height="'), height, F.lit('">\n'), label(F.col("l"), 200, "end"), label(F.col("r"), 400, "start"), line, F.lit("</svg>\n")).alias("text"))


def coverage(docs: DataFrame) -> DataFrame:
    """Share of ids with at least one link, and links to nowhere, over all documents."""
    c = Catalog(docs)
    ids = c.ids().select(F.struct("doc", "id").alias("key"))
    ends = c.edges().select(F.struct("doc", F.col("from").alias("id")).alias("key")).unionByName(c.edges().select(F.struct("doc", F.col("to").alias("id")).alias("key")))
    return _coverage(ids, ends, "key")


def quality(scores: dict[str, Column], weights: dict[str, float], grades: tuple[tuple[float, str], ...] = ((0.9, "A"), (0.75, "B"), (0.6, "C"), (0.4, "D"))) -> tuple[Column, Column]:
    """Weighted score from 0 to 1 and its grade. Weights and cut-offs are the caller's; the defaults are ours."""
    total = sum(weights.values())
    score = sum((scores[k] * F.lit(w / total) for k, w in weights.items()), F.lit(0.0))
    grade = F.lit("F")
    for cut, name in sorted(grades):
        grade = F.when(score >= cut, name).otherwise(grade)
    return score, grade


def consistency(links: DataFrame) -> DataFrame:
    """(from, to, problem): the same link twice, or one pair under several relations."""
    per = links.groupBy("from", "to").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("relation").alias("k"))
    return per.where("n > 1").select("from", "to", F.when(F.col("k") > 1, "several relations").otherwise("repeated link").alias("problem"))


def link_status(links: DataFrame, targets: DataFrame) -> DataFrame:
    """Links with ``stale``: whether their target (column ``to``) is gone; and with it the mean confidence by relation is one aggregate away."""
    there = targets.select(F.col("to")).distinct().withColumn("_there", F.lit(True))
    return links.join(there, "to", "left").withColumn("stale", F.col("_there").isNull()).drop("_there")


def flow_edges(docs: DataFrame) -> DataFrame:
    """(doc, flow, from, to, condition): each step leads to the step of the action it names for success, else to the next one; to that named for failure; and to the steps that its conditions name."""
    steps = Catalog(docs).section("flows").select("doc", F.col("e.id").alias("flow"), F.col("e.steps").alias("steps"))
    edge = lambda s, to, condition: F.struct(s["id"].alias("from"), to.alias("to"), condition.alias("condition"))
    following = F.transform("steps", lambda s, i: F.when(s["on_success_action_id"].isNull(), edge(s, F.get("steps", i + 1)["id"], F.lit(None).cast("string"))))
    doing = lambda action: F.filter("steps", lambda t: t["action"] == action)
    after = lambda key: F.flatten(F.transform("steps", lambda s: F.transform(doing(s[f"{key}_action_id"]), lambda t: edge(s, t["id"], F.lit(key)))))
    ids = F.transform("steps", lambda s: s["id"])
    named = F.flatten(F.transform("steps", lambda s: F.transform(F.coalesce(s["conditions"], F.array().cast("array<string>")), lambda c: edge(s, F.regexp_extract(c, r"([^\s:]+)\s*$", 1), c))))
    found = F.concat(F.filter(following, lambda x: x["to"].isNotNull()), after("on_success"), after("on_failure"), F.filter(named, lambda x: F.array_contains(ids, x["to"])))
    return steps.select("doc", "flow", F.inline(found))


#: Kinds of elements that a relation may lead from and to. Ours; the language names relations but not their ends.
APPROPRIATE = {
    "implements": ("action flow feature", "feature scenario constraint"), "verifies": ("feature scenario", "feature action constraint entity"), "tests": ("scenario feature", "feature action flow entity"),
    "calls": ("action flow scenario", "action flow"), "configures": ("constraint action", "action entity flow"), "represented_by": ("entity", "entity"),
}


def link_forms(docs: DataFrame, appropriate: dict[str, tuple[str, str]] = APPROPRIATE, form: str = r"[A-Za-z_][A-Za-z0-9_.:#/-]*") -> DataFrame:
    """(doc, from, to, relation, problem): ends that are no identifiers, and relations between kinds of elements that they do not fit. Relations that are not listed fit everywhere."""
    c = Catalog(docs)
    edges = c.trace().select("doc", "from", "to", "relation")
    kinds = c.ids().where("id <> ''").groupBy("doc", "id").agg(F.min("kind").alias("kind"))
    out = [edges.where(~F.col(end).rlike(f"^(?:{form})$")).withColumn("problem", F.lit(f"'{end}' is no identifier")) for end in ("from", "to")]
    for k, end in enumerate(("from", "to")):
        fits = reduce(Column.__or__, ((F.col("relation") == r) & ~F.col("kind").isin(*ends[k].split()) for r, ends in appropriate.items()), F.lit(False))
        known = edges.join(kinds.withColumnRenamed("id", end), ["doc", end]).where(fits)
        out.append(known.select("doc", "from", "to", "relation", F.concat("relation", F.lit(f" does not fit {end} "), "kind").alias("problem")))
    return union_all(out)


def meta_links(meta: DataFrame) -> DataFrame:
    """(doc, from, to, relation): the links of all feature metadata, which one traceability file would hold."""
    s = meta.where("document is not null").select("doc", F.explode("document.feature.scenarios").alias("s"))
    return s.select("doc", F.col("s.id").alias("from"), F.inline("s.traceability"))


def meta_findings(meta: DataFrame, steps: DataFrame, scenario_lines: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc, problem): metadata whose feature file is missing, whose lines name no scenario, whose ids repeat in the project, or whose targets do not exist.

    ``steps``: files as (file); ``scenario_lines``: (file, line); ``ids``: (id) of actions, requirements and interfaces.
    """
    m = meta.where("document is not null").select("doc", "document.feature.*")
    own = m.select("doc", "file", F.explode("scenarios").alias("s")).select("doc", "file", "s.*")
    all_ids = m.select("doc", "id").unionByName(own.select("doc", "id"))
    twice = all_ids.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    return union_all(
        [
            m.join(steps, "file", "left_anti").select("doc", F.concat(F.lit("missing file: "), F.coalesce("file", F.lit(""))).alias("problem")),
            own.join(scenario_lines.select("file", F.col("line").cast("string").alias("line")), ["file", "line"], "left_anti").select("doc", F.concat(F.lit("no scenario at line: "), F.coalesce("line", F.lit(""))).alias("problem")),
            all_ids.join(twice, "id", "left_semi").select("doc", F.concat(F.lit("repeated id: "), "id").alias("problem")),
            meta_links(meta).join(ids.withColumnRenamed("id", "to"), "to", "left_anti").select("doc", F.concat(F.lit("unknown target: "), "to").alias("problem")),
        ]
    )


def principles(spark: SparkSession) -> DataFrame:
    """(group, code, name) of the design principles."""
    return spark.createDataFrame([(g, c, n) for g, codes in PRINCIPLES.items() for c, n in codes.items()], "group string, code string, name string")


def unknown_principles(used: DataFrame) -> DataFrame:
    """(doc, code) that the taxonomy lacks."""
    return used.select("doc", "code").distinct().where(~F.col("code").isin(*(c for codes in PRINCIPLES.values() for c in codes)))


def principle_coverage(spark: SparkSession, used: DataFrame) -> DataFrame:
    """(doc, group, declared, total): how many principles of each group a document declares."""
    table = principles(spark)
    total = table.groupBy("group").agg(F.count(F.lit(1)).alias("total"))
    return used.select("doc", "code").distinct().join(F.broadcast(table), "code").groupBy("doc", "group").agg(F.count(F.lit(1)).alias("declared")).join(F.broadcast(total), "group")


def undeclared(used: DataFrame, declared: DataFrame) -> DataFrame:
    """Principles that strategies name but the document does not declare: (doc, code)."""
    return used.select("doc", "code").distinct().join(declared.select("doc", "code"), ["doc", "code"], "left_anti")
