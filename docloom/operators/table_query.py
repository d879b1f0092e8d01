"""Small table queries: a validated plan compiled to a DataFrame.

A plan names an operation, a metric column, a group column, selected columns and
filters. It is checked against the table's schema before anything runs.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPERATIONS = ("LOOKUP", "COUNT", "SUM", "MAX", "MIN", "GROUP_COUNT", "GROUP_SUM")
FILTERS = ("EQ", "CONTAINS", "GT", "GTE", "LT", "LTE")


class PlanError(ValueError):
    """A plan that does not fit the table."""


@dataclass
class TablePlan:
    operation: str
    metric: str | None = None
    group_by: str | None = None
    columns: list[str] = field(default_factory=list)
    filters: list[tuple[str, str, object]] = field(default_factory=list)
    limit: int | None = None


def validate(plan: TablePlan, frame: DataFrame) -> None:
    """Raises PlanError unless operation, columns, types and filters fit."""
    types = {f.name: f.dataType for f in frame.schema}
    if plan.operation not in OPERATIONS:
        raise PlanError(f"unknown operation {plan.operation!r}")
    named = [*plan.columns, *[c for c, _, _ in plan.filters], *[c for c in (plan.metric, plan.group_by) if c]]
    if unknown := [c for c in named if c not in types]:
        raise PlanError(f"unknown columns {unknown}")
    if plan.operation in ("SUM", "MAX", "MIN", "GROUP_SUM"):
        if not plan.metric or not isinstance(types[plan.metric], T.NumericType):
            raise PlanError(f"{plan.operation} needs a numeric metric column")
    if plan.operation.startswith("GROUP_") and not plan.group_by:
        raise PlanError(f"{plan.operation} needs a group column")
    if bad := [op for _, op, _ in plan.filters if op not in FILTERS]:
        raise PlanError(f"unknown filters {bad}")


def _filter(column: str, op: str, value: object) -> Column:
    c = F.col(column)
    return {
        "EQ": lambda: c == value,
        "CONTAINS": lambda: c.cast("string").contains(str(value)),
        "GT": lambda: c > value,
        "GTE": lambda: c >= value,
        "LT": lambda: c < value,
        "LTE": lambda: c <= value,
    }[op]()


def run(plan: TablePlan, frame: DataFrame) -> DataFrame:
    """The plan's result; filters and columns reach the scan, aggregates are partial before the shuffle."""
    validate(plan, frame)
    for f in plan.filters:
        frame = frame.where(_filter(*f))
    if plan.operation == "LOOKUP":
        out = frame.select(*plan.columns) if plan.columns else frame
        return out.limit(plan.limit) if plan.limit else out
    measure = {"COUNT": F.count("*"), "GROUP_COUNT": F.count("*")}.get(plan.operation)
    if measure is None:
        measure = {"SUM": F.sum, "GROUP_SUM": F.sum, "MAX": F.max, "MIN": F.min}[plan.operation](plan.metric)
    grouped = frame.groupBy(plan.group_by) if plan.operation.startswith("GROUP_") else frame
    return grouped.agg(measure.alias("result"))


def pivot_cells(cells: DataFrame, columns: list[str]) -> DataFrame:
    """Long cells (table_id, row_no, column_name, text) as rows with the named columns."""
    return cells.groupBy("table_id", "row_no").pivot("column_name", columns).agg(F.first("text"))
