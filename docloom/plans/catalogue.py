"""All registered queries with their SQL twins."""

from __future__ import annotations

_QUERIES: dict = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with the SQL that gives the same rows."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLES[f.__name__] = sql
        return f

    return add


def load() -> None:
    """Imports the modules that register queries."""
    from docloom.plans import block_queries, candidate_queries, fusion_queries, graph_queries, quality_queries, relational_queries, retrieval_queries, scalar_queries, source_queries, suite_queries, text_queries  # noqa: F401


def queries() -> dict:
    load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    load()
    return _ORACLES
