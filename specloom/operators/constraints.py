"""Declared field constraints as predicates over real tables: (check, violations), in one pass, plus one pre-aggregate for each unique field."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import OTHER_TYPE, TYPES
from .relational import union_all, violations

EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
UUID = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"


def broken(column: Column, kind: str, value=None) -> Column:
    """Whether a value breaks a constraint; null breaks only ``required``. Patterns must match the whole value."""
    test = {
        "required": lambda: column.isNull(),
        "min_length": lambda: F.length(column) < int(value),
        "max_length": lambda: F.length(column) > int(value),
        "min_value": lambda: column < value,
        "max_value": lambda: column > value,
        "pattern": lambda: ~column.rlike(f"^(?:{value})$"),
        "enum": lambda: ~column.isin(*value),
        "email": lambda: ~column.rlike(EMAIL),
        "uuid": lambda: ~column.rlike(UUID),
    }
    if kind not in test:
        raise ValueError(f"unknown constraint {kind!r}")
    return F.coalesce(test[kind](), F.lit(False))


def check(df: DataFrame, rules: list[tuple[str, str, object]]) -> DataFrame:
    """(check, violations) of (column, kind, value) rules; ``unique`` counts rows whose value occurs elsewhere too."""
    simple = {f"{c} {k}": broken(F.col(c), k, v) for c, k, v in rules if k != "unique"}
    out = [violations(df, simple)] if simple else []
    for c in (c for c, k, _ in rules if k == "unique"):
        n = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        out.append(n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations")).select(F.lit(f"{c} unique").alias("check"), "violations"))
    return union_all(out)


_WORD = re.compile(r"\s*(?:(?P<number>\d+(?:\.\d+)?)|(?P<text>'[^']*'|\"[^\"]*\")|(?P<name>[A-Za-z_]\w*\.[A-Za-z_]\w*)|(?P<word>and|or|not|true|false|null|is)\b|(?P<sign><=|>=|<>|!=|==|[-+*/()<>=]))", re.I)


def rule_expression(rule: str) -> tuple[str, set[str]]:
    """A rule's text as SQL over ``entity.field`` columns, and its entities. Only comparisons, arithmetic, and, or, not, is null and literals are taken: rules in prose raise ValueError."""
    out, entities, at = [], set(), 0
    while rule[at:].strip():
        m = _WORD.match(rule, at)
        if not m:
            raise ValueError(f"not a rule that can be run: {rule!r}")
        at = m.end()
        if m["name"]:
            entity, field = m["name"].split(".")
            entities.add(entity)
            out.append(f"`{entity}`.`{field}`")
        elif m["text"]:
            out.append("'" + m["text"][1:-1].replace("\\", "\\\\").replace("'", "\\'") + "'")
        else:
            out.append("=" if m["sign"] == "==" else m[0].strip())
    if not entities:
        raise ValueError(f"a rule without a field: {rule!r}")
    return " ".join(out), entities


def rule_violations(tables: dict[str, DataFrame], rules: dict[str, str], joins: dict[tuple[str, str], tuple[str, str]] | None = None) -> DataFrame:
    """(check, violations): how many rows break each rule; a null result breaks none. A rule over several entities counts rows of the first table that ``joins``, as
    {(child, parent): (child column, parent column)}, names as their child, with their parents; rows without a parent break none."""
    out = []
    for name, rule in rules.items():
        sql, used = rule_expression(rule)
        links = {k: v for k, v in (joins or {}).items() if set(k) <= used}
        child = next((k[0] for k in links), None) or next(iter(used))
        df, have = tables[child].alias(child), {child}
        while len(have) < len(used):
            step = next(((k, v) for k, v in links.items() if (k[0] in have) != (k[1] in have)), None)
            if step is None:
                raise ValueError(f"no join for the entities of {rule!r}")
            (a, b), (x, y) = step
            new = b if a in have else a
            df = df.join(tables[new].alias(new), F.col(f"{a}.{x}") == F.col(f"{b}.{y}"))
            have.add(new)
        out.append(df.agg(F.count_if(F.coalesce(~F.expr(sql), F.lit(False))).alias("violations")).select(F.lit(name).alias("check"), "violations"))
    return union_all(out)


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def table_ddl(fields: list[dict]) -> str:
    """Columns of an entity as DDL; an absent ``required`` means required."""
    one = lambda f: f"`{f['name']}` {TYPES['spark'].get(f['type'], OTHER_TYPE['spark'])}" + (" NOT NULL" if f.get("required") in (None, True) else "")
    return ", ".join(map(one, fields))
