"""Metadata filters: a JSON condition compiled to a column.

``{"version": 1, "and"|"or": [{"field": ..., "op": ..., "value": ...}]}`` with the
operators = != contains in "not in" empty "not empty".
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATORS = ("=", "!=", "contains", "in", "not in", "empty", "not empty")


class FilterError(ValueError):
    """A condition that cannot be compiled."""


def _term(condition: dict, fields: dict[str, Column], arrays: set[str], only_empty: set[str]) -> Column:
    name, op, value = condition.get("field"), condition.get("op"), condition.get("value")
    if name not in fields:
        raise FilterError(f"unknown field {name!r}")
    if op not in OPERATORS:
        raise FilterError(f"unknown operator {op!r}")
    if name in only_empty and op not in ("empty", "not empty"):
        raise FilterError(f"{name} can only be tested for being empty")
    column = fields[name]
    if op in ("empty", "not empty"):
        bare = F.coalesce(F.size(column), F.lit(0)) <= 0 if name in arrays else F.coalesce(column.cast("string"), F.lit("")) == ""
        return bare if op == "empty" else ~bare
    if op in ("in", "not in"):
        if not isinstance(value, list) or any(v is None for v in value):
            raise FilterError(f"{op!r} needs a list without nulls")
        inside = F.arrays_overlap(column, F.array(*[F.lit(v) for v in value])) if name in arrays else column.isin(value)
        inside = F.coalesce(inside, F.lit(False))
        return inside if op == "in" else ~inside
    if value is None:
        raise FilterError(f"{op!r} needs a value")
    if op == "contains":
        return F.coalesce(F.array_contains(column, value) if name in arrays else column.cast("string").contains(str(value)), F.lit(False))
    same = F.coalesce(F.array_contains(column, value) if name in arrays else column == value, F.lit(False))
    return same if op == "=" else ~same


def compile_filter(condition: str | dict, fields: dict[str, Column], arrays: set[str] = frozenset(), only_empty: set[str] = frozenset()) -> Column:
    """The condition as one boolean column, so that it reaches the scan; no condition keeps all rows."""
    parsed = json.loads(condition) if isinstance(condition, str) else condition
    if not parsed:
        return F.lit(True)
    if parsed.get("version") != 1:
        raise FilterError("only version 1 is known")
    joins = [k for k in ("and", "or") if k in parsed]
    if len(joins) != 1 or not parsed[joins[0]]:
        raise FilterError("one of and, or with conditions is needed")
    terms = [_term(c, fields, arrays, only_empty) for c in parsed[joins[0]]]
    return reduce((lambda a, b: a & b) if joins[0] == "and" else (lambda a, b: a | b), terms)
