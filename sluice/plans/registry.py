"""Where every runnable query registers itself, with its SQL where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def with_ctes(*parts: str) -> str:
    """``WITH`` the leading parts, then the last one as the statement."""
    return "WITH RECURSIVE " + ",\n".join(p.strip() for p in parts[:-1]) + "\n" + parts[-1].strip()
