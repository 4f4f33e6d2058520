"""Query registry: name -> (callable, equivalent SQL or None)."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}

MODULES = [
    "q_schema",
    "q_windows",
    "q_joins",
    "q_aggregates",
    "q_bins",
    "q_spatial",
    "q_text",
    "q_forecast",
    "q_models",
    "q_sources",
]


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = (fn, sql)
        return fn

    return register


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"{__package__}.{m}")


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {n: fn for n, (fn, _) in _QUERIES.items()}


def all_sql() -> dict[str, str]:
    _load()
    return {n: sql for n, (_, sql) in _QUERIES.items() if sql is not None}
