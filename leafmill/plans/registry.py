"""Named queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leafmill.plans.fixtures import with_tables

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(sql: str | None = None, tables: str = "") -> Callable[[Query], Query]:
    """Register a function under its own name; ``tables`` names fixture tables of ``sql``."""

    def add(function: Query) -> Query:
        name = function.__name__
        QUERIES[name] = function
        if sql is not None:
            CHECKS[name] = with_tables(tables, sql) if tables else sql.strip()
        return function

    return add
