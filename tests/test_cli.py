import json
import os

import pytest

from specloom import cli

SPEC = "metadata: {version: '1'}\nentities: [{id: u, fields: [{name: id, type: string}]}]\nactions: []\nfeatures: []\n"
UP = """id: "1"
up:
  - {type: add_field, entity_id: u, field_name: age, field_type: integer, default: 18}
  - {type: add_feature, id: f, title: F}
down:
  - {type: remove_feature, id: f}
  - {type: remove_field, entity_id: u, field_name: age}
"""
NEXT = 'id: "2"\ndependencies: ["1"]\nup: [{type: add_action, id: a, name: A}]\ndown: []\n'


@pytest.fixture
def project(spark, tmp_path):
    (tmp_path / "s.yaml").write_text(SPEC)
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "1.yaml").write_text(UP)
    return tmp_path


def run(*args):
    said = []
    code = cli.run([str(a) for a in args], said.append)
    return code, "\n".join(map(str, said))


def test_apply_then_rollback_restores_the_document(project):
    spec, m = project / "s.yaml", project / "m"
    before = cli.load(str(spec))
    assert run("migrate", "apply", "-p", m, "-t", spec, "--dry-run") == (0, "1\n    + Add field 'age' (integer) to entity 'u'\n    + Add feature: f (F)\nWould apply: 1 migrations")
    assert not (m / cli.STATE_FILE).exists() and cli.load(str(spec)) == before
    assert run("migrate", "apply", "-p", m, "-t", spec)[0] == 0
    doc = cli.load(str(spec))
    assert [f["name"] for f in doc["entities"][0]["fields"]] == ["id", "age"] and doc["features"][0]["id"] == "f"
    assert os.listdir(project / cli.BACKUPS)
    (m / "2.yaml").write_text(NEXT)
    assert "Applied: 1\nPending: 1\n  - 2" in run("migrate", "status", "-p", m)[1]
    assert run("migrate", "rollback", "-p", m, "-t", spec)[0] == 0
    assert cli.load(str(spec)) == before and json.loads((m / cli.STATE_FILE).read_text())["applied_migrations"] == []
    assert run("migrate", "apply", "-p", m, "-t", spec)[0] == 0
    code, said = run("migrate", "rollback", "-p", m, "-t", spec)
    assert code == 1 and "has no down operations" in said
    (m / cli.STATE_FILE).write_text("{broken")
    assert "Applied: 0" in run("migrate", "status", "-p", m)[1]


def test_add_list_validate_generate(project):
    spec = project / "s.yaml"
    assert run("add", "entity", "--id", "e", "--name", "E", "--target", spec)[0] == 0
    assert run("add", "field", "--entity-id", "e", "--field-name", "x", "--field-type", "float", "--default", "1.5", "--target", spec)[0] == 0
    assert cli.load(str(spec))["entities"][1]["fields"][0]["default"] == "1.5"
    assert run("add", "field", "--entity-id", "none", "--field-name", "x", "--field-type", "float", "--target", spec) == (1, "Error: Entity 'none' not found")
    assert run("add", "entity", "--id", " ", "--name", "E", "--target", spec) == (1, "Error: AddEntity operation requires non-empty id and name")
    assert "Entities (2):" in run("list", "entities", "--target", spec)[1]
    assert "is valid" in run("validate", spec)[1]
    assert run("add", "entity", "--id", "e", "--name", "E", "--target", spec)[0] == 0
    assert run("validate", spec)[0] == 0 and run("validate", spec, "--strict")[0] == 1
    assert json.loads(run("validate", spec, "-o", "json")[1]) == {"valid": False, "error_count": 1, "errors": ["Duplicate ID found: 'e'"]}
    out = project / "out"
    assert "generated 3 files" in run("generate", spec, "-l", "py", "-o", out, "--with-tests")[1]
    (out / "main.py").write_text("mine")
    assert "generated 1 files" in run("generate", spec, "-l", "py", "-o", out)[1] and (out / "main.py").read_text() == "mine"
    assert json.loads(run("parse", spec)[1])["entities"][1]["fields"][0]["default"] == 1.5
    assert run("validate", project / "none.yaml")[0] == 1


def test_init(tmp_path):
    assert run("init", tmp_path / "p")[0] == 0 and run("init", tmp_path / "p")[0] == 1
    assert run("parse", tmp_path / "p" / "specs" / "example.yaml", "-o", "yaml")[0] == 0


def test_folders_suffixes_and_formats(project):
    folder = project / "specs"
    (folder / "deep").mkdir(parents=True)
    (folder / "a.own").write_text(SPEC)
    (folder / "deep" / "b.yaml").write_text(SPEC.replace("id: u", "id: v") + "traceability: [{from: v, to: w, relation: tests}]\n")
    out = project / "out"
    assert "generated 6 files" in run("--suffix", ".own", "generate", folder, "-l", "py", "-o", out)[1]
    assert "class U(" in (out / "a" / "models.py").read_text() and "class V(" in (out / "deep" / "b" / "models.py").read_text()
    assert run("validate", folder / "a.own")[0] == 1 and run("--suffix", ".own", "validate", folder / "a.own")[0] == 0
    assert run("trace", "matrix", folder / "deep" / "b.yaml", "-f", "csv", "-o", project / "m.csv")[0] == 0 and (project / "m.csv").read_text() == '"from","w"\n"v","tests"\n'
    assert run("trace", "graph", folder / "deep" / "b.yaml", "-f", "svg")[1].startswith("<svg")
    assert run("trace", "validate", folder / "deep" / "b.yaml") == (1, "v -> w (tests): unknown 'to'")
    said = run("--verbose", "validate", folder / "deep" / "b.yaml")[1]
    assert "Reading " in said and "YAML suffixes: .yaml .yml" in said and "Traceback" in run("--verbose", "validate", project / "none.yaml")[1]
