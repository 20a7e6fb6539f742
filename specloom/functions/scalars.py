"""Scalar functions as Column expressions; all stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Type names of the specification language and what they are called in each target.
TYPES = {
    "typescript": {"string": "string", "int": "number", "integer": "number", "float": "number", "double": "number", "bool": "boolean", "boolean": "boolean", "date": "Date", "datetime": "Date"},
    "python": {"string": "str", "int": "int", "integer": "int", "float": "float", "double": "float", "bool": "bool", "boolean": "bool", "date": "date", "datetime": "datetime"},
    "go": {"string": "string", "int": "int64", "integer": "int64", "float": "float64", "double": "float64", "bool": "bool", "boolean": "bool", "date": "time.Time", "datetime": "time.Time"},
    "spark": {"string": "string", "int": "bigint", "integer": "bigint", "float": "double", "double": "double", "bool": "boolean", "boolean": "boolean", "date": "date", "datetime": "timestamp_ntz"},
}
OTHER_TYPE = {"typescript": "any", "python": "Any", "go": "interface{}", "spark": "variant"}
# Sample literals of generated tests. The Go table is keyed by Go type names.
SAMPLES = {
    "typescript": {"string": '"test"', "int": "42", "integer": "42", "float": "42", "double": "42", "bool": "true", "boolean": "true", "date": "new Date()", "datetime": "new Date()"},
    "python": {"string": '"test"', "int": "42", "integer": "42", "float": "42.0", "double": "42.0", "bool": "True", "boolean": "True", "date": "date.today()", "datetime": "datetime.now()"},
    "go": {"string": '"test"', "int64": "42", "float64": "42.0", "bool": "true", "time.Time": "time.Now()"},
}
OTHER_SAMPLE = {"typescript": "null", "python": "None", "go": "nil"}
# Prefixes of action ids and their verbs.
VERBS = {"get_": "GET", "list_": "GET", "create_": "POST", "add_": "POST", "update_": "PUT", "modify_": "PUT", "delete_": "DELETE", "remove_": "DELETE"}
OTHER_VERB = "POST"


def looked_up(c: Column, table: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for k, v in table.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def pascal_case(c: Column) -> Column:
    """Parts between underscores, each with its first letter upper-cased and the rest kept."""
    return F.array_join(F.transform(F.split(c, "_", -1), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))), "")


def http_verb(c: Column) -> Column:
    out = F.lit(OTHER_VERB)
    for prefix, verb in reversed(VERBS.items()):
        out = F.when(F.startswith(c, F.lit(prefix)), verb).otherwise(out)
    return out


def route_name(c: Column) -> Column:
    return F.replace(c, F.lit("_"), F.lit("-"))


def type_name(c: Column, language: str) -> Column:
    return looked_up(c, TYPES[language], OTHER_TYPE[language])


def sample_value(c: Column, language: str) -> Column:
    return looked_up(c, SAMPLES[language], OTHER_SAMPLE[language])


def trimmed(c: Column) -> Column:
    """Without white space, in the sense of Unicode, at both ends."""
    return F.regexp_replace(c, r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", "")


def is_blank(c: Column) -> Column:
    """Null, empty, or only white space."""
    return F.coalesce(trimmed(c), F.lit("")) == ""


def number_text(c: Column) -> Column:
    """A double in shortest plain notation: no exponent, no point if whole."""
    plain = F.regexp_replace(F.format_string("%s", c.cast("decimal(38,10)").cast("string")), r"\.?0+$", "")
    whole = F.regexp_replace(c.cast("decimal(38,0)").cast("string"), r"\.0+$", "")
    return F.when(c == F.rint(c), whole).otherwise(plain)


def default_literal(json: Column) -> Column:
    """A JSON literal as Python source: strings quoted as they are, True and False, numbers; lists and objects are None."""
    first = F.substring(json, 1, 1)
    return (
        F.when(json.isNull(), None)
        .when(first == '"', F.concat(F.lit('"'), F.get_json_object(F.concat(F.lit('{"x":'), json, F.lit("}")), "$.x"), F.lit('"')))
        .when(json == "true", "True")
        .when(json == "false", "False")
        .when(first.rlike(r"[-0-9]"), number_text(json.try_cast("double")))
        .otherwise("None")
    )


def cli_default(c: Column) -> Column:
    """What a default given on a command line means, as JSON text: exactly true or false, else a number if it has the form of one, else a string."""
    number = c.rlike(r"^[-+]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][-+]?[0-9]+)?$")
    return F.when(c.isin("true", "false"), c).when(number, c.try_cast("double").cast("string")).otherwise(F.to_json(F.struct(c.alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(c.alias("x")))) - 6))
