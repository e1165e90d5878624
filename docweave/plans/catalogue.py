"""All registered queries of the library, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_oracles: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query under a name, with the SQL that gives the same rows."""

    def put(f):
        _queries[name] = f
        if sql:
            _oracles[name] = sql
        return f

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _queries


def oracles() -> dict[str, str]:
    return _oracles


from . import cascade, linkage, pages, reports  # noqa: E402, F401  they register their queries
