"""Named queries over a folder of parquet tables, each with the SQL stating its expected result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def load_all() -> tuple[dict[str, Query], dict[str, str]]:
    from . import context_queries, core_queries, stream_queries, text_queries  # noqa: F401  (registration)
    return QUERIES, ORACLES
