"""All queries of the library by name, with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None) -> Callable:
    """Register a function (spark, sf_dir) under its name (or another), with SQL that gives the same rows."""

    def add(function: Callable) -> Callable:
        QUERIES[name or function.__name__] = function
        if oracle:
            ORACLES[name or function.__name__] = oracle
        return function

    return add


def _load() -> None:
    from newslink.plans import article_queries, event_queries, revision_queries, stream_queries, table_queries  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return ORACLES
