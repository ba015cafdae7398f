"""Every query by name, and its SQL. A query takes a Tables object; its SQL reads the same shapes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .sources.adapters import Tables, with_shapes

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of Tables under a name, with SQL where SQL can say the same."""

    def put(f):
        if name in _QUERIES:
            raise ValueError(name)
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return put


def _load() -> None:
    from .plans import admin_queries, catalog_queries, order_queries, publish_queries, refresh_queries, snapshot_queries, social_queries, store_queries  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {n: (lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))) for n, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {n: with_shapes(s) for n, s in _SQL.items()}
