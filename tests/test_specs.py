import json

import pytest

from specloom.operators import migrate, render, rules, trace
from specloom.plans.catalog import Catalog
from specloom.sources import legacy, specs
from specloom.sources.specs import parse_specs, parse_text

BAD = """
entities:
  - {id: "", fields: []}
  - {id: twice, fields: [{name: "", type: string}, {name: x, type: ""}]}
features:
  - {id: f, title: "", scenarios: [{id: "", title: "", given: [], when: [], then: []}, {id: twice, title: t, given: [g], when: [w], then: [t]}]}
  - {id: g, title: G, scenarios: [], dependencies: [f, gone, ""]}
actions: [{id: ""}, {id: twice}]
flows: [{id: "", name: "", steps: []}]
constraints: [{id: c, name: "", type: rule, rule: ""}]
traceability: [{from: f, to: away, relation: tests}, {from: away, to: g, relation: odd}]
"""


def docs(spark, *texts):
    return parse_specs(spark.createDataFrame([(f"d{k}", t) for k, t in enumerate(texts)], "doc string, text string"))


def messages(spark, text):
    d = docs(spark, text)
    return rules.report(d, rules.validate(d)).first().errors


def test_every_rule_has_its_message_in_order(spark):
    assert messages(spark, BAD) == [
        "Entity at index 0 is missing required 'id' field",
        "Feature 'f' is missing required 'title' field",
        "Scenario at index 0 in feature 'f' is missing required 'id' field",
        "Scenario '' in feature 'f' is missing required 'title' field",
        "Action at index 0 is missing required 'id' field",
        "Flow at index 0 is missing required 'id' field",
        "Flow '' is missing required 'name' field",
        "Constraint 'c' is missing required 'name' field",
        "Constraint 'c' is missing required 'rule' field",
        "Duplicate ID found: 'twice'",
        "Duplicate ID found: 'twice'",
        "Feature 'g' references unknown dependency: 'gone'",
        "Traceability references unknown 'to' element: 'away'",
        "Traceability references unknown 'from' element: 'away'",
        "Field in entity 'twice' is missing required 'name'",
        "Field 'x' in entity 'twice' is missing required 'type'",
    ]


def test_corpus_is_judged_document_by_document(spark):
    d = docs(spark, BAD, "entities: [{id: twice, fields: []}]", "entities: [{fields: []}]", "entity: {}", "")
    got = {r.doc: r.error_count for r in rules.report(d, rules.validate(d)).collect()}
    assert got == {"d0": 16, "d1": 0, "d3": 0, "d4": 0}
    assert d.where("doc = 'd2'").first().error == "YAML parsing failed: entities[]: missing field `id`"
    with pytest.raises(rules.StrictError):
        rules.strict_gate(rules.validate(d))


@pytest.mark.parametrize("text, value", [("0", "0.0"), ("'0'", '"0"'), ("yes", '"yes"'), ("true", "true"), ("1e3", "1000.0"), ("010", "10.0"), ("2024-01-01", '"2024-01-01"'), ("[1, a]", '[1.0, "a"]'), ("~", None)])
def test_literals_follow_the_core_schema(text, value):
    doc = parse_text(f"entities: [{{id: e, fields: [{{name: n, type: t, default: {text}}}]}}]", specs.document_type())
    assert doc["entities"][0]["fields"][0]["default"] == value


@pytest.mark.parametrize("text", ["entities: 5", "entities: [{id: 5, fields: []}]", "a: 1\na: 2", "entities: [{id: x, fields: [{name: n, type: t, required: maybe}]}]", "[1"])
def test_wrong_shapes_are_unreadable(spark, text):
    assert docs(spark, text).first().document is None


def test_files_and_default_file(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("entities: [{id: a, fields: []}]")
    (tmp_path / "b.yaml").write_text("entities: []")
    assert specs.read_specs(spark, str(tmp_path)).count() == 2
    names = spark.createDataFrame([(f"/x/{n}",) for n in ("zoo.own", "main.own", "app.own", "a.yaml", "app.yml", "food.txt")], "path string")
    assert specs.default_file(names).first().path == "/x/app.yml"
    assert specs.default_file(names, (".own",)).first().path == "/x/main.own" and specs.default_file(names.where("path like '%txt'")).first() is None
    assert [r[0] for r in names.select(specs.is_yaml(names["path"], (*specs.SUFFIXES, ".own"))).collect()] == [True] * 5 + [False]


def test_listing_and_reports(spark):
    d = docs(spark, BAD)
    assert rules.listing_text(d, "features").first()[1] == "Features (2):\n  • f - \n    Scenarios: 2\n  • g - G"
    assert rules.listing_text(docs(spark, ""), "actions").first()[1] == "No actions found"
    r = rules.report(docs(spark, ""), rules.validate(docs(spark, "")))
    assert json.loads(rules.report_json(r).first()[1]) == {"valid": True, "error_count": 0, "errors": []}
    assert rules.report_text(r).first()[1] == "✓ d0 is valid"
    text = rules.report_text(rules.report(d, rules.validate(d))).first()[1]
    assert text.startswith("Validation warnings for d0\n  1. Entity at") and text.endswith("--strict flag to treat warnings as errors")


def test_gherkin(spark):
    t = "@x\nFeature: Buy\n  Scenario: One\n    Given a cart\n    # no\n    And an item\n  Scenario: Two\n    Then done\n"
    got = [tuple(r) for r in specs.read_gherkin(spark.createDataFrame([("f", t)], "doc string, text string")).orderBy("line").collect()]
    assert got == [("f", 4, "Buy", "One", "Given", "a cart"), ("f", 6, "Buy", "One", "And", "an item"), ("f", 8, "Buy", "Two", "Then", "done")]


# --- migrations


def test_order_puts_needs_first_and_finds_cycles():
    needs = {"c": ["a", "b"], "b": ["a", "unknown"], "a": []}
    assert migrate.ordered({"a", "b", "c"}, needs, {"a", "b", "c"}) == ["a", "b", "c"]
    assert migrate.ordered({"a", "b", "c"}, needs, {"c"}) == ["c"]
    with pytest.raises(migrate.MigrationError, match="Circular dependency detected involving migration '[ab]'"):
        migrate.ordered({"a", "b"}, {"a": ["b"], "b": ["a"]}, {"a"})


DOC = "entities: [{id: u, fields: [{name: id, type: string}]}]\nfeatures: [{id: f, title: F, scenarios: []}]\nactions: [{id: a}]"


def op(kind, **rest):
    return {"type": kind} | rest


@pytest.mark.parametrize(
    "ops, error",
    [
        ([op("remove_field", entity_id="u", field_name="x")], "Field 'x' not found in entity 'u'"),
        ([op("remove_entity", id="u"), op("add_field", entity_id="u", field_name="x", field_type="int")], "Entity 'u' not found"),
        ([op("modify_entity", id="x")], "Entity 'x' not found"),
        ([op("update_action", id="x")], "Action 'x' not found"),
        ([op("change_validation", target_id="u", target_type="field")], "Unsupported target type for validation: field"),
        ([op("change_validation", target_id="x", target_type="action")], "Action 'x' not found"),
    ],
)
def test_first_failing_operation_stops_the_batch(spark, ops, error):
    doc = parse_text(DOC, specs.document_type())
    before = json.dumps(doc)
    with pytest.raises(migrate.MigrationError, match=error):
        migrate.fold(doc, ops)
    assert json.dumps(doc) == before


def test_operations_change_what_they_name():
    doc = parse_text(DOC, specs.document_type())
    got = migrate.fold(
        doc,
        [op("add_feature", id="n", title="N", scenarios=["One", "Two"]), op("add_entity", id="e", name="E"), op("add_field", entity_id="e", field_name="x", field_type="int", default="5"), op("add_field", entity_id="e", field_name="y", field_type="int", default="[1]"),
         op("modify_entity", id="u", new_name="User"), op("update_action", id="a", new_description="D"), op("add_constraint", id="c", name="C", condition="x > 1", applies_to="e"), op("change_validation", target_id="u", target_type="entity"), op("remove_feature", id="f"), op("remove_feature", id="f")],
    )
    assert [f["id"] for f in got["features"]] == ["n"] and [s["id"] for s in got["features"][0]["scenarios"]] == ["n_scenario_1", "n_scenario_2"]
    assert [(f["name"], f["default"]) for f in got["entities"][1]["fields"]] == [("x", "5.0"), ("y", '"null"')]
    assert got["entities"][0]["name"] == "User" and got["actions"][0]["description"] == "D"
    assert got["constraints"][0]["type"] == "rule" and got["constraints"][0]["rule"] == "x > 1"


def test_replay_of_a_corpus(spark):
    d = docs(spark, DOC, DOC)
    ops = spark.createDataFrame([("d0", 2, ("remove_field", "u", "age", None)), ("d0", 1, ("add_field", "u", "age", "int")), ("d1", 1, ("remove_field", "u", "none", None))], "doc string, seq int, op struct<type: string, entity_id: string, field_name: string, field_type: string>")
    got = {r.doc: (r.error, r.document) for r in migrate.replay_corpus(d, ops).collect()}
    want = d.first().document
    assert got["d0"] == (None, want) and got["d1"] == ("Field 'none' not found in entity 'u'", want)


# --- rendering, traces


SHOP = """
entities: [{id: cart_item, description: A thing, fields: [{name: item_id, type: int}, {name: note, type: string, required: false}, {name: price, type: float, default: 18}, {name: what, type: uuid, required: false, default: hi}]}]
actions: [{id: list_items}, {id: buy, input: {entity: cart_item}}, {id: get_it, input: {fields: [x]}}]
features: [{id: f, title: T, scenarios: [{id: s, title: S, given: [a, b], when: [c], then: [d]}]}]
"""


def files(df):
    return {r.path: r.content for r in df.collect()}


def test_rendered_files(spark):
    d = docs(spark, SHOP)
    py = files(render.generate(d, "py"))
    assert py["models.py"].split("\n\n", 1)[1] == 'class CartItem(BaseModel):\n    """A thing"""\n    item_id: int\n    note: Optional[str] = None\n    price: float = 18\n    what: Optional[Any] = "hi"\n\n'
    assert '@router.post("/buy")\nasync def buy(data: CartItem):' in py["routes.py"] and '@router.get("/get-it")\nasync def get_it(data: dict):' in py["routes.py"] and '@router.get("/list-items")\nasync def list_items():' in py["routes.py"]
    ts = files(render.generate(d, "ts"))
    assert ts["types.ts"] == "// Generated entity interfaces\n\nexport interface CartItem {\n  item_id: number;\n  note?: string;\n  price: number;\n  what?: any;\n}\n\n"
    assert "  // Input: unknown\n" in ts["routes.ts"] and ts["routes.ts"].endswith("export default router;\n")
    go = files(render.generate(d, "go"))
    assert "    What interface{} `json:\"what\"`\n" in go["types.go"] and '    api.GET("/list-items", ListItems)\n    api.POST("/buy", Buy)\n' in go["handlers.go"]
    assert set(go) == {"types.go", "handlers.go", "go.mod", "main.go"}
    t = files(render.tests(d, "ts"))
    assert "      // Given: a\n      // Given: b\n      // When: c\n      // Then: d\n" in t["tests/f.feature.test.ts"] and "      item_id: 42,\n" in t["tests/cart_item.test.ts"]
    assert "        price=42.0,\n" in files(render.tests(d, "python"))["tests/test_cart_item.py"]
    assert "        ItemId: nil,\n" in files(render.tests(d, "go"))["cart_item_test.go"]
    assert set(files(render.generate(docs(spark, ""), "python"))) == {"requirements.txt", "main.py"}
    with pytest.raises(render.GeneratorError):
        render.generate(d, "cobol")


def test_traces(spark):
    d = docs(spark, BAD)
    got = {tuple(r)[1:] for r in trace.validate(d).select("doc", "from", "to", "problem").collect()}
    assert got == {("f", "away", "unknown 'to'"), ("away", "g", "unknown 'from'"), ("away", "g", "unknown relation")}
    assert '  "f" -> "away" [label="tests"];\n' in trace.graph(d).first().dot
    assert trace.coverage(d).first().right_orphans >= 1
    assert trace.matrix(d).where("from = 'f'").first().links[0].to == "away"
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "from string, to string")
    assert [r.path for r in trace.cycles(e).collect()] == ["a -> b -> a"]
    assert Catalog(d).edges().count() == 5


def test_long_cycles_and_many_ways(spark):
    edge = lambda rows: spark.createDataFrame(rows, "from string, to string")
    ring = [(f"n{k:03d}", f"n{(k + 1) % 200:03d}") for k in range(200)]
    got = trace.cycles(edge([*ring, ("x", "n000"), ("n001", "y"), ("z", "z")])).collect()
    assert sorted((r.node, r.path.count("->")) for r in got) == [("n000", 200), ("z", 1)]
    deep = [(f"d{k:05d}", f"d{k + 1:05d}") for k in range(20_000)]  # a walk deeper than Python's own stack
    assert trace.cycles(edge(deep)).count() == 0
    diamonds = [e for k in range(30) for e in ((f"a{k}", f"b{k}"), (f"a{k}", f"c{k}"), (f"b{k}", f"a{k + 1}"), (f"c{k}", f"a{k + 1}"))]  # 2^30 ways
    got = {r.node: r.depth for r in trace.depths(edge(diamonds), "to", "from").collect()}
    assert got["a0"] == 0 and got["a30"] == 60 and got["c7"] == 15 and len(got) == 91
    small = [*diamonds[:12], ("p", "q"), ("q", "p"), ("q", "r"), ("a1", "r")]
    one, rounds = ({r.node: r.depth for r in trace.depths(edge(small), "to", "from", one_task=n).collect()} for n in (100, 3))
    assert one == rounds and one["p"] is one["q"] is one["r"] is None and one["a3"] == 6
    assert trace.depths(edge([]), "to", "from").count() == 0 and trace.cycles(edge([])).count() == 0


def test_exports(spark):
    d = docs(spark, "entities: [{id: e, fields: []}]\nfeatures: [{id: 'f<', title: F, scenarios: [], dependencies: [e]}]\ntraceability: [{from: e, to: 'f<', relation: tests}, {from: e, to: e, relation: calls}]")
    assert trace.matrix_text(d, "csv").first().text == '"from","e","f<"\n"e","calls","tests"\n"f<","depends_on",""\n'
    assert "<tr><th>f&lt;</th><td>depends_on</td><td></td></tr>" in trace.matrix_text(d, "html").first().text
    assert json.loads(trace.matrix_text(d, "json").first().text)[1] == {"from": "f<", "links": [{"to": "e", "relation": "depends_on"}]}
    svg = trace.graph_svg(d).first().text
    assert svg.count("<line") == 3 and "f&lt;" in svg and svg.endswith("</svg>\n")
    with pytest.raises(ValueError):
        trace.matrix_text(d, "png")


def test_legacy_grammar():
    text = "metadata:\n  version: '1'\nentity:\n  id: e # note\n  name: \"A \\\"b\\\"\"\n  fields:\n    - name: x\n    - name: y\naction:\n  id: a\n  input:\n    deep: 1\nsystem:\n  id: s\n  components:\n    - one\n"
    doc = legacy.parse(text)
    assert doc["metadata"]["version"] == "1" and doc["entities"][0]["name"] == 'A "b"' and [f["name"] for f in doc["entities"][0]["fields"]] == ["x", "y"]
    assert doc["actions"] == [{"id": "placeholder"}] and doc["system"]["components"] == ["one"]
    assert legacy.tokenize("a:\n    b:\n        c: 1\nd: 2")[-1].kind == "end"
    for bad in ("entity:\n  id: 'x", "a:\n    b: 1\n  c: 2", "entity:\n  fields:\n    - name: x\n      type: y\n", "what: 1"):
        with pytest.raises(legacy.GrammarError):
            legacy.parse(bad)


META = """
feature:
  id: buy
  file: buy.feature
  scenarios:
    - {id: one, title: One, line: 3, action: pay, traceability: [{to: BR-1, relation: implements}, {to: BR-9, relation: tests}]}
    - {id: buy, title: Two, line: 9}
"""


def test_feature_metadata(spark):
    from specloom.model import feature_meta_type

    meta = parse_specs(spark.createDataFrame([("m", META.replace("line: 3", "line: '3'").replace("line: 9", "line: '9'"))], "doc string, text string"), "FAILFAST", feature_meta_type())
    frame = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    got = {r.problem for r in trace.meta_findings(meta, frame([("other.feature",)], "file string"), frame([("buy.feature", 3)], "file string, line int"), frame([("BR-1",)], "id string")).collect()}
    assert got == {"missing file: buy.feature", "no scenario at line: 9", "repeated id: buy", "unknown target: BR-9"}
    assert {(r["from"], r.to) for r in trace.meta_links(meta).collect()} == {("one", "BR-1"), ("one", "BR-9")}


def test_flows_links_and_principles(spark):
    d = docs(spark, "flows: [{id: f, name: F, steps: [{id: a, action: x, conditions: ['on_failure: c']}, {id: b, action: y}, {id: c, action: z}]}]")
    assert {(r["from"], r.to) for r in trace.flow_edges(d).collect()} == {("a", "b"), ("b", "c"), ("a", "c")}
    d = docs(spark, "flows: [{id: f, name: F, steps: [{id: a, action: x, on_success_action_id: z, on_failure_action_id: x}, {id: b, action: y, on_failure_action_id: gone}, {id: c, action: z}]}]")
    assert {(r["from"], r.to, r.condition) for r in trace.flow_edges(d).collect()} == {("a", "c", "on_success"), ("a", "a", "on_failure"), ("b", "c", None)}
    links = spark.createDataFrame([("a", "b", "tests"), ("a", "b", "blocks"), ("c", "d", "tests"), ("c", "d", "tests"), ("e", "f", "tests")], "from string, to string, relation string")
    assert {tuple(r) for r in trace.consistency(links).collect()} == {("a", "b", "several relations"), ("c", "d", "repeated link")}
    assert {r.to for r in trace.link_status(links, spark.createDataFrame([("b",)], "to string")).where("stale").collect()} == {"d", "f"}
    used = spark.createDataFrame([("d", "Si"), ("d", "Mo"), ("d", "Zz")], "doc string, code string")
    assert [r.code for r in trace.unknown_principles(used).collect()] == ["Zz"] and trace.principles(spark).count() == 45
    assert tuple(trace.principle_coverage(spark, used).select("group", "declared", "total").first()) == ("Structure", 2, 6)
    assert trace.undeclared(used, used.where("code = 'Si'")).count() == 2


def test_extended_operations_are_optional():
    doc = parse_text(DOC + "\ntraceability: [{from: f, to: a, relation: tests}]", specs.document_type())
    ops = [op("modify_feature", id="f", new_name="New"), {"type": "update_traceability_link", "from": "f", "to": "a", "relation": "verifies"}, {"type": "add_traceability_link", "from": "f", "to": "u", "relation": "tests"}, {"type": "remove_traceability_link", "from": "f", "to": "u"}]
    with pytest.raises(migrate.MigrationError):
        migrate.fold(doc, ops)
    got = migrate.fold(doc, ops, extended=True)
    assert got["features"][0]["title"] == "New" and [t["relation"] for t in got["traceability"]] == ["verifies"]
