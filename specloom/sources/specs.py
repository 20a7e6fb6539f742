"""YAML documents as rows.

Files are read by Spark as whole texts. A Python stage turns YAML into JSON text shaped by the schema, and the JVM parses that into structs. A document that lacks a
required key, or holds a wrong shape, is unreadable as a whole: ``error`` says why and ``document`` is null (PERMISSIVE), or reading fails (FAILFAST). Unknown keys are ignored; null is absent.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import REQUIRED, document_type, migration_type
from ..shipping import ship

_NUMBER = re.compile(r"[-+]?(\d[\d_]*)?(\.\d*)?([eE][-+]?\d+)?")


def _scalar(text: str, plain: bool):
    """A scalar in the YAML 1.2 core sense: null, true and false, numbers; quoted ones are strings."""
    if not plain:
        return text
    if text in ("", "~", "null", "Null", "NULL"):
        return None
    if text in ("true", "True", "TRUE"):
        return True
    if text in ("false", "False", "FALSE"):
        return False
    if re.fullmatch(r"0x[0-9a-fA-F]+", text):
        return float(int(text, 16))
    if re.fullmatch(r"0o[0-7]+", text):
        return float(int(text[2:], 8))
    if re.fullmatch(r"[-+]?(\d+(\.\d*)?|\.\d+)([eE][-+]?\d+)?", text):
        return float(text)
    return text


def load_yaml(text: str):
    """A YAML text as lists, dicts, strings and (value, text) pairs for plain scalars, so that fields of type string keep their spelling."""
    import yaml

    class Plain(tuple):
        pass

    class Loader(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
        pass

    def scalar(loader, node):
        return (_scalar(node.value, not node.style), node.value, not node.style)

    def mapping(loader, node):
        loader.flatten_mapping(node)
        out = {}
        for k, v in node.value:
            key = k.value
            if key in out:
                raise ValueError(f"duplicate entry with key {key!r}")
            out[key] = loader.construct_object(v, deep=True)
        return out

    for tag in ("str", "int", "float", "bool", "null", "timestamp", "binary"):
        Loader.add_constructor(f"tag:yaml.org,2002:{tag}", scalar)
    Loader.add_constructor("tag:yaml.org,2002:map", mapping)
    return yaml.load(text, Loader)


def literal(value):
    """A literal value as JSON data; every number is a double."""
    if isinstance(value, tuple):
        return value[0]
    if isinstance(value, list):
        return [literal(v) for v in value]
    if isinstance(value, dict):
        return {k: literal(v) for k, v in value.items()}
    return value


LITERALS = {"default", "value"}


def shaped(value, kind: T.DataType, path: str = "", name: str = ""):
    """``value`` in the form of ``kind``, or ValueError with the place."""
    if isinstance(value, tuple) and value[0] is None and value[2] or value is None:
        return None
    if isinstance(kind, T.StructType):
        if not isinstance(value, dict):
            raise ValueError(f"{path or 'document'}: expected a mapping")
        out = {}
        for f in kind.fields:
            sub = f"{path}.{f.name}" if path else f.name
            got = shaped(value.get(f.name), f.dataType, sub, f.name)
            if got is None and f.name in REQUIRED.get(path, ()):
                raise ValueError(f"{path or 'document'}: missing field `{f.name}`")
            out[f.name] = got
        return out
    if isinstance(kind, T.ArrayType):
        if not isinstance(value, list):
            raise ValueError(f"{path}: expected a sequence")
        return [shaped(v, kind.elementType, f"{path}[]", name) for v in value]
    if name in LITERALS and isinstance(kind, T.StringType):
        return json.dumps(literal(value))
    if not isinstance(value, tuple):
        raise ValueError(f"{path}: expected a scalar")
    if isinstance(kind, T.BooleanType):
        if not isinstance(value[0], bool):
            raise ValueError(f"{path}: expected a boolean")
        return value[0]
    if value[2] and not isinstance(value[0], str):
        raise ValueError(f"{path}: invalid type, expected a string")
    return value[1]


def _operation(op: dict) -> dict:
    changes = op.get("changes")
    if isinstance(changes, dict):
        op = op | {"new_name": changes.get("name"), "new_description": changes.get("description")}
    return op


def parse_text(text: str, kind: T.StructType, migration: bool = False) -> dict:
    data = load_yaml(text)
    if data is None or isinstance(data, tuple) and data[0] is None:
        if migration:
            raise ValueError("missing field `id`")
        data = {}
    if migration:
        for part in ("up", "down"):
            if not isinstance(data.get(part), list):
                raise ValueError(f"missing field `{part}`")
            data[part] = [_operation(o) for o in data[part]]
        if data.get("id") is None:
            raise ValueError("missing field `id`")
    out = shaped(data, kind)
    if not migration:  # absent lists are empty
        for f in kind.fields:
            if isinstance(f.dataType, T.ArrayType) and out[f.name] is None:
                out[f.name] = []
    return out


def parse_specs(texts: DataFrame, mode: str = "PERMISSIVE", kind: T.StructType | None = None, migration: bool = False) -> DataFrame:
    """(doc, text) -> (doc, error, document)."""
    kind = kind or (migration_type() if migration else document_type())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, errors = [], []
            for text in b.column(1).to_pylist():
                try:
                    found.append(json.dumps(parse_text(text or "", kind, migration)))
                    errors.append(None)
                except Exception as e:
                    if mode == "FAILFAST":
                        raise ValueError(f"YAML parsing failed: {e}") from None
                    found.append(None)
                    errors.append(f"YAML parsing failed: {e}")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(errors, pa.string()), pa.array(found, pa.string())], ["doc", "error", "json"])

    ship(texts.sparkSession)
    rows = texts.select("doc", "text").mapInArrow(run, "doc string, error string, json string")
    return rows.select("doc", "error", F.from_json("json", kind).alias("document"))


#: Suffixes of files that are read as YAML; a project with others names them. Files of other suffixes are in the older grammar.
SUFFIXES = (".yaml", ".yml")


def is_yaml(path: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """Whether a path is read as YAML."""
    return reduce(Column.__or__, (F.endswith(path, F.lit(s)) for s in suffixes))


def read_texts(spark: SparkSession, *paths: str, glob: str | None = None) -> DataFrame:
    """(doc, text) of whole files; doc is the path."""
    reader = spark.read
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("doc"), F.col("value").alias("text"))


def read_specs(spark: SparkSession, *paths: str, mode: str = "PERMISSIVE") -> DataFrame:
    """Documents of a file, several, or a folder of them."""
    return parse_specs(read_texts(spark, *paths), mode)


def default_file(paths: DataFrame, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """The file that commands take when none is named: spec, specification, main, app in this order, else the first of all with one of the suffixes."""
    base = F.element_at(F.split("path", "/"), -1)
    stem = F.regexp_replace(base, r"\.[^.]*$", "")
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, ("spec", "specification", "main", "app"))), stem), F.lit(0))
    return paths.where(is_yaml(base, suffixes)).orderBy(F.when(rank == 0, 99).otherwise(rank), "path").limit(1)


def read_migrations(spark: SparkSession, folder: str) -> DataFrame:
    """(id, migration) of the YAML files right in a folder; of equal ids the last path counts. One bad file fails all. A missing folder is empty."""
    empty = spark.createDataFrame([], "id string, migration struct<" + ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in migration_type().fields) + ">")
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(folder)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return empty
    parsed = parse_specs(read_texts(spark, folder, glob="*.{yaml,yml}"), "FAILFAST", migration=True)
    return parsed.groupBy(F.col("document.id").alias("id")).agg(F.max_by("document", "doc").alias("migration"))


def read_gherkin(texts: DataFrame) -> DataFrame:
    """(doc, text) of feature files -> (doc, line, feature, scenario, keyword, text), one row for each step, without comments and tags."""
    lines = texts.select("doc", F.posexplode(F.split("text", "\r?\n")).alias("line", "raw"))
    from pyspark.sql import Window as W

    w = W.partitionBy("doc").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    m = lambda words: F.regexp_extract("raw", rf"^\s*({words}):?\s*(.*?)\s*$", 2)
    is_ = lambda words: F.col("raw").rlike(rf"^\s*({words})\b")
    steps = "Given|When|Then|And|But"
    named = lines.withColumns({"feature": F.last(F.when(is_("Feature"), m("Feature")), True).over(w), "scenario": F.last(F.when(is_("Scenario|Scenario Outline"), m("Scenario Outline|Scenario")), True).over(w)})
    return named.where(is_(steps)).select("doc", (F.col("line") + 1).alias("line"), "feature", "scenario", F.regexp_extract("raw", rf"^\s*({steps})", 1).alias("keyword"), m(steps).alias("text"))
