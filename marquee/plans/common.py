"""The list of named queries, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Name a query after its function; ``sql`` is left out where SQL cannot say or is too slow."""
    def add(make: Callable[[SparkSession, str], DataFrame]):
        QUERIES[make.__name__] = make
        if sql is not None:
            SQL[make.__name__] = sql
        return make
    return add


def text_list(values) -> str:
    """Values as a list of SQL string literals."""
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def value_rows(rows) -> str:
    """Rows of strings as the body of a SQL VALUES clause."""
    return ", ".join(f"({text_list(r)})" for r in rows)
