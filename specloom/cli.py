"""Commands over one specification file: init, parse, validate, generate, add, list, migrate, trace. ``python -m specloom.cli COMMAND …``; exit code 1 on any error."""

from __future__ import annotations

import argparse
import json
import os
import shutil
import sys
from datetime import UTC, datetime

from pyspark.sql import SparkSession

from .operators import migrate, render, rules, trace
from .sources import legacy, specs

STATE_FILE, BACKUPS = ".migration_state.json", ".backups"
FOLDERS = ("specs", "migrations", "generated", "tests", "docs", "templates")
EXAMPLE = """metadata:
  version: "1.3"
entities:
  - id: example
    fields:
      - name: id
        type: string
        required: true
"""


class ProjectError(Exception):
    pass


ERRORS = (ProjectError, ValueError, migrate.MigrationError, render.GeneratorError, rules.StrictError, legacy.GrammarError, OSError)


def now() -> str:
    return datetime.now(UTC).isoformat()


def session() -> SparkSession:
    return SparkSession.builder.master(os.environ.get("SPARK_MASTER", "local[2]")).config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def load(path: str, suffixes: tuple[str, ...] = specs.SUFFIXES) -> dict:
    """A file as a document. Files of the given suffixes are read as YAML, others in the older grammar."""
    try:
        with open(path, encoding="utf-8") as f:
            text = f.read()
    except OSError as e:
        raise ProjectError(f"Failed to read file '{path}': {e}") from None
    if path.endswith(suffixes):
        try:
            return specs.parse_text(text, specs.document_type())
        except Exception as e:
            raise ValueError(f"YAML parsing failed: {e}") from None
    return legacy.parse(text)


def files(path: str, suffixes: tuple[str, ...]) -> list[str]:
    """The file, or those of a folder, that have one of the suffixes."""
    found = [path] if not os.path.isdir(path) else sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(suffixes))
    if not found:
        raise ProjectError(f"No specification file found in '{path}'")
    return found


def frame(spark: SparkSession, path: str, suffixes: tuple[str, ...] = specs.SUFFIXES):
    """(doc, document) of a file or of all files of a folder."""
    kind = specs.document_type()
    from pyspark.sql import functions as F

    return spark.createDataFrame([(p, json.dumps(load(p, suffixes))) for p in files(path, suffixes)], "doc string, json string").select("doc", F.from_json("json", kind).alias("document"))


def plain(value):
    """A document as data for output: JSON literals are parsed, absent values stay null."""
    if isinstance(value, dict):
        return {k: (json.loads(v) if k in specs.LITERALS and isinstance(v, str) else plain(v)) for k, v in value.items()}
    if isinstance(value, list):
        return [plain(v) for v in value]
    return value


def save(document: dict, path: str) -> None:
    """Writes the whole document beside its file, then takes its place."""
    import yaml

    with open(f"{path}.new", "w", encoding="utf-8") as f:
        yaml.safe_dump(plain(document), f, sort_keys=False, allow_unicode=True)
    os.replace(f"{path}.new", path)


def backup(path: str) -> str | None:
    if not os.path.exists(path):
        return None
    folder = os.path.join(os.path.dirname(os.path.abspath(path)), BACKUPS)
    os.makedirs(folder, exist_ok=True)
    to = os.path.join(folder, f"backup_{datetime.now(UTC):%Y%m%d_%H%M%S}{os.path.splitext(path)[1]}")
    shutil.copyfile(path, to)
    return to


def empty_document() -> dict:
    return specs.parse_text("", specs.document_type())


def init(name: str, force: bool = False) -> list[str]:
    """A project's folders and files. An existing folder is an error; ``force`` is accepted but does not change that."""
    if os.path.exists(name):
        raise ProjectError(f"Directory '{name}' already exists")
    for d in FOLDERS:
        os.makedirs(os.path.join(name, d))
    files = {"specs/example.yaml": EXAMPLE, "README.md": f"# {os.path.basename(name)}\n", ".gitignore": "generated/\n", "project.yaml": f"name: {os.path.basename(name)}\n"}
    for f, text in files.items():
        with open(os.path.join(name, f), "w", encoding="utf-8") as out:
            out.write(text)
    return sorted(files)


def write_files(rows, out: str, folder: str | None = None) -> list[str]:
    """Writes (doc, path, content, keep_existing) rows; those to be kept are left alone if there. Documents of a folder keep their places in it."""
    done = []
    for r in rows:
        path = os.path.join(out, os.path.splitext(os.path.relpath(r.doc, folder))[0] if folder else "", r.path)
        if r.keep_existing and os.path.exists(path):
            continue
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            f.write(r.content)
        done.append(path)
    return done


class Project:
    """Migrations in a folder, their state, and the target document."""

    def __init__(self, spark: SparkSession, folder: str, target: str | None, suffixes: tuple[str, ...] = specs.SUFFIXES) -> None:
        self.spark, self.target, self.suffixes, self.state_path = spark, target, suffixes, os.path.join(folder, STATE_FILE)
        self.migrations = specs.read_migrations(spark, folder)
        self.state = migrate.read_state(spark, self.state_path)
        self.applied = migrate.applied_frame(spark, self.state)

    def document(self) -> dict:
        return load(self.target, self.suffixes) if self.target and os.path.exists(self.target) else empty_document()

    def operations(self, ids: list[str], part: str) -> list[dict]:
        found = {r.id: r.migration.asDict(True) for r in self.migrations.where(self.migrations.id.isin(ids)).collect()} if ids else {}
        return [op for i in ids for op in (found[i][part] if part == "up" else found[i][part][::-1])]

    def commit(self, document: dict, state: dict) -> None:
        if self.target:
            save(document, self.target)
        with open(f"{self.state_path}.new", "w", encoding="utf-8") as f:
            json.dump(state, f, indent=2)
        os.replace(f"{self.state_path}.new", self.state_path)

    def apply(self, dry: bool = False) -> list[str]:
        ids = migrate.plan(self.migrations, self.applied)
        if ids and not dry:
            if self.target:
                backup(self.target)
            self.commit(migrate.fold(self.document(), self.operations(ids, "up")), migrate.with_applied(self.state, ids, now()))
        return ids

    def rollback(self, n: int, dry: bool = False) -> list[str]:
        bad = migrate.rollback_errors(self.applied, self.migrations, n).orderBy("ord", ascending=False).first()
        if bad:
            raise migrate.MigrationError(bad.error)
        ids = [r.id for r in migrate.rollback_plan(self.applied, n).collect()]
        if ids and not dry:
            if self.target:
                backup(self.target)
            self.commit(migrate.fold(self.document(), self.operations(ids, "down")), migrate.without_applied(self.state, ids, now()))
        return ids


def add(target: str, op: dict, suffixes: tuple[str, ...] = specs.SUFFIXES) -> None:
    """One operation, checked first, on an existing file."""
    if not os.path.exists(target):
        raise ProjectError(f"Target file '{target}' does not exist")
    migrate.check_operation(op)
    save(migrate.fold(load(target, suffixes), [op]), target)


def default_target(suffixes: tuple[str, ...] = specs.SUFFIXES, folder: str = ".") -> str:
    spark = session()
    row = specs.default_file(spark.createDataFrame([(os.path.join(folder, f),) for f in sorted(os.listdir(folder))], "path string"), suffixes).first()
    if not row:
        raise ProjectError("No specification file found")
    return row.path


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="specloom")
    p.add_argument("--verbose", action="store_true", help="say which files are read, and how an error came about")
    p.add_argument("--suffix", action="append", default=[], help="a further suffix of files that are read as YAML, as .spec")
    s = p.add_subparsers(dest="command", required=True)
    c = s.add_parser("init")
    c.add_argument("name")
    c.add_argument("--force", action="store_true")
    c = s.add_parser("parse")
    c.add_argument("file")
    c.add_argument("-o", "--output", default="json")
    c.add_argument("-d", "--debug", action="store_true")
    c = s.add_parser("validate")
    c.add_argument("file")
    c.add_argument("--strict", action="store_true")
    c.add_argument("-o", "--output", default="text")
    c = s.add_parser("generate")
    c.add_argument("input")
    c.add_argument("-l", "--language", required=True)
    c.add_argument("-o", "--output", default="generated")
    c.add_argument("-t", "--template")
    c.add_argument("--with-tests", action="store_true")
    a = s.add_parser("add").add_subparsers(dest="kind", required=True)
    for kind, names in {"feature": ["id", "title"], "entity": ["id", "name"], "action": ["id", "name"], "constraint": ["id", "name", "condition", "applies-to"], "field": ["entity-id", "field-name", "field-type"]}.items():
        c = a.add_parser(kind)
        for n in names:
            c.add_argument(f"--{n}", required=True)
        for n in ("description", "message", "default", "target"):
            c.add_argument(f"--{n}")
        c.add_argument("--scenarios", nargs="*")
        c.add_argument("--required", action="store_true")
    c = s.add_parser("list")
    c.add_argument("kind", choices=["features", "entities", "actions", "constraints"])
    c.add_argument("--target")
    m = s.add_parser("migrate").add_subparsers(dest="kind", required=True)
    for kind in ("apply", "rollback", "status"):
        c = m.add_parser(kind)
        c.add_argument("-p", "--path", default="migrations")
        c.add_argument("-t", "--target")
        c.add_argument("--dry-run", action="store_true")
        c.add_argument("-n", "--count", type=int, default=1)
    t = s.add_parser("trace").add_subparsers(dest="kind", required=True)
    for kind, forms in {"validate": (), "graph": ("dot", "svg"), "matrix": ("text", "csv", "html", "json")}.items():
        c = t.add_parser(kind)
        c.add_argument("file")
        if forms:
            c.add_argument("-f", "--format", choices=forms, default=forms[0])
            c.add_argument("-o", "--output")
    return p


def run(argv: list[str], say=print) -> int:
    a = parser().parse_args(argv)
    try:
        return _run(a, say)
    except ERRORS as e:
        say(f"Error: {e}")
        if a.verbose:
            import traceback

            say("".join(traceback.format_exception(e)))
        return 1


def _run(a: argparse.Namespace, say) -> int:
    suffixes = (*specs.SUFFIXES, *a.suffix)
    if a.verbose:
        say(f"YAML suffixes: {' '.join(suffixes)}")
        for f in files(getattr(a, "file", None) or getattr(a, "input", None) or ".", suffixes) if a.command in ("parse", "validate", "generate", "trace") else ():
            say(f"Reading {f}")
    if a.command == "init":
        init(a.name, a.force)
        say(f"Created project {a.name}")
    elif a.command == "parse":
        import yaml

        data = plain(load(a.file, suffixes))
        say(yaml.safe_dump(data, sort_keys=False, allow_unicode=True) if a.output == "yaml" else json.dumps(data, indent=2, ensure_ascii=False))
    elif a.command == "validate":
        docs = frame(session(), a.file, suffixes)
        report = rules.report(docs, rules.validate(docs))
        for row in (rules.report_json(report) if a.output == "json" else rules.report_text(report, a.strict)).orderBy("doc").collect():
            say(row[1])
        if a.strict:
            rules.strict_gate(rules.validate(docs))
    elif a.command == "generate":
        docs = frame(session(), a.input, suffixes)
        one = not os.path.isdir(a.input)  # the files of a folder's documents go to folders of their own
        done = write_files(render.generate(docs, a.language).collect(), a.output, None if one else a.input)
        say(f"Successfully generated {len(done)} files:")
        if a.with_tests:
            more = write_files(render.tests(docs, a.language).collect(), a.output, None if one else a.input)
            say(f"Generated {len(more)} test files:")
            done += more
        for f in done:
            say(f"  - {f}")
    elif a.command == "add":
        op = {k.replace("-", "_"): v for k, v in vars(a).items() if v is not None} | {"type": f"add_{a.kind}"}
        if a.kind == "field":
            op["default"] = None if a.default is None else _cli_default(a.default)
        target = a.target or default_target(suffixes)
        add(target, op, suffixes)
        say(f"Successfully added {a.kind}")
    elif a.command == "list":
        say(rules.listing_text(frame(session(), a.target or default_target(suffixes), suffixes), a.kind).first()[1])
    elif a.command == "migrate":
        p = Project(session(), a.path, a.target, suffixes)
        if a.kind == "status":
            r = migrate.status(p.migrations, p.applied).first()
            say(f"Total: {r.total}\nApplied: {r.applied_count}\nPending: {r.pending_count}")
            for i in r.pending:
                say(f"  - {i}")
        else:
            ids = p.apply(a.dry_run) if a.kind == "apply" else p.rollback(a.count, a.dry_run)
            if a.dry_run and ids:
                from pyspark.sql import functions as F

                part = "up" if a.kind == "apply" else "down"
                ops = p.migrations.where(F.col("id").isin(ids)).select(F.col("id").alias("mid"), F.posexplode(f"migration.{part}").alias("n", "o")).select("mid", "n", "o.*")
                lines = {(r.mid, r.n): r.line for r in ops.select("mid", "n", migrate.describe().alias("line")).collect()}
                for i in ids:
                    say(i)
                    for k in sorted(k for k in lines if k[0] == i):
                        say(lines[k])
            say(f"{'Would ' if a.dry_run else ''}{a.kind}: {len(ids)} migrations")
    else:
        docs = frame(session(), a.file, suffixes)
        if a.kind == "graph":
            _out(a, say, "".join(r[1] for r in (trace.graph(docs) if a.format == "dot" else trace.graph_svg(docs)).orderBy("doc").collect()))
        elif a.kind == "matrix" and a.format != "text":
            _out(a, say, "".join(r.text for r in trace.matrix_text(docs, a.format).orderBy("doc").collect()))
        elif a.kind == "matrix":
            _out(a, say, "\n".join(f"{r['from']}: " + ", ".join(f"{x.to} ({x.relation})" for x in r.links) for r in trace.matrix(docs).orderBy("doc", "from").collect()))
        else:
            bad = trace.validate(docs).orderBy("from", "to", "problem").collect()
            loops = trace.cycles(trace.Catalog(docs).edges(), group="doc").orderBy("doc", "node").collect()
            for r in bad:
                say(f"{r['from']} -> {r.to} ({r.relation}): {r.problem}")
            for r in loops:
                say(f"cycle: {r.path}")
            return int(bool(bad or loops))
    return 0


def _out(a: argparse.Namespace, say, text: str) -> None:
    if not a.output:
        return say(text)
    with open(a.output, "w", encoding="utf-8") as f:
        f.write(text)
    say(f"Wrote {a.output}")


def _cli_default(text: str) -> str:
    """As functions.scalars.cli_default, for one value."""
    import re

    if text in ("true", "false"):
        return text
    if re.fullmatch(r"[-+]?(\d+(\.\d*)?|\.\d+)([eE][-+]?\d+)?", text):
        return json.dumps(float(text))
    return json.dumps(text)


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
