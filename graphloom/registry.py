"""The registered queries of the graph engine and, by the same names, their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with SQL for the same rows where there is any."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        if key in _QUERIES:
            raise ValueError(f"query {key} is registered twice")
        _QUERIES[key] = f
        if sql:
            _ORACLES[key] = sql
        return f

    return add


def _load() -> None:
    from graphloom.queries import answering, evaluation, graph, orchestration, outside, patterns, retrieval, text, triples  # noqa: F401


def core_queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def core_oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
