"""Registry of the library's own queries: name -> (callable, DuckDB statement or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name."""

    def add(f: Query) -> Query:
        REGISTRY[f.__name__] = (f, sql)
        return f

    return add
