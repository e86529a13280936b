"""All queries of the engine's own operators, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .inputs import with_sql

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL if there is one."""

    def add(function: Query) -> Query:
        key = name or function.__name__
        _QUERIES[key] = function
        if sql is not None:
            _ORACLES[key] = with_sql(sql)
        return function

    return add


def _load() -> None:
    from . import answering_plans, citation_plans, evaluation_plans, ingest_plans, retrieval_plans, usage_plans  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
