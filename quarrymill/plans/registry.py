"""The registry of queries: a name, a callable on (spark, folder) and, where SQL can say it, the equivalent DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrymill.session import table

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(name: str, tables: str, sql: str | None = None):
    """Register a function of the named tables (separated by blanks)."""

    def add(f):
        _queries[name] = lambda spark, d: f(*[table(spark, d, t) for t in tables.split()])
        if sql:
            _sql[name] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from quarrymill.plans import arrays, filters, measures, ordering, relations, scores, scoring, tokens, udfs  # noqa: F401

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_sql)
