"""The registry of queries: each has a name, a builder, and the SQL of the same result."""

from __future__ import annotations

import difflib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are called {name}")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def get(name: str) -> Query:
    if name not in QUERIES:
        close = difflib.get_close_matches(name, QUERIES, n=3)
        raise KeyError(f"no query {name!r}" + (f"; did you mean {', '.join(close)}?" if close else ""))
    return QUERIES[name]
