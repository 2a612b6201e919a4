"""Registration of queries with their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with DuckDB SQL for the same rows where SQL can say it."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def strings(values: list[str]) -> str:
    """A SQL list of string literals."""
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def rlike(column: str, patterns: list[str]) -> str:
    """SQL: the column matches any pattern."""
    return "(" + " OR ".join(f"regexp_matches({column}, '{p.replace(chr(39), chr(39) * 2)}')" for p in patterns) + ")"


def has(column: str, parts: list[str]) -> str:
    """SQL: the column contains any part."""
    return "(" + " OR ".join(f"contains({column}, '{p.replace(chr(39), chr(39) * 2)}')" for p in parts) + ")"
