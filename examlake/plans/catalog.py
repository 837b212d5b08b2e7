"""Queries over the driver's tables, each with its SQL where SQL can say it. Names begin with the inventory rows they serve."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _loaded() -> None:
    for name in ("corpus_queries", "usage_queries", "text_queries", "layout_queries", "tree_queries", "work_queries"):
        importlib.import_module(f"examlake.plans.{name}")


def queries() -> dict[str, Query]:
    _loaded()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    _loaded()
    return dict(_SQL)
