"""The registry of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views_sql import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = ""):
    """Register a query; ``sql`` may use the views named in ``views``."""

    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = with_views(views.split(), sql)
        return f

    return put
