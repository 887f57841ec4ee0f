"""The registered queries and their SQL, gathered from the modules of this folder."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function ``(spark, sf_dir)`` under its name, with the SQL that gives the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def load() -> tuple[dict[str, Callable], dict[str, str]]:
    from . import calls_queries, change_queries, file_queries, flow_queries, join_queries, nested_queries, profile_queries, rule_queries  # noqa: F401

    return QUERIES, SQL
