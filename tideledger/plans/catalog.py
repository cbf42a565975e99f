"""Registry of the queries: name → (Spark query, equivalent SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without SQL only its rows are checked by the tests."""

    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"Query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def with_sql(*parts: str) -> str:
    """``WITH`` the given common tables, then the select."""
    *tables, select = parts
    return f"WITH {', '.join(tables)} {select}" if tables else select
