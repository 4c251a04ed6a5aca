"""All queries of the engine, by name."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}

MODULES = ("item_queries", "report_queries", "build_queries", "explore_queries", "layout_queries", "text_queries", "quality_queries", "page_queries", "drawing_queries", "stream_queries")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with its SQL if there is one."""

    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def with_parts(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def r3(x: str, places: int = 3) -> str:
    """The SQL of functions.scalars.half_up."""
    k = 10**places
    return f"floor(({x}) * {k} + 0.5) / {k}"


def _load() -> None:
    for m in MODULES:
        import_module(f"gradeloom.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
