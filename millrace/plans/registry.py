"""Named queries: what each operator returns on the driver's tables, and the same statement for an oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Decorator: adds a query under ``name``, with DuckDB SQL where it exists."""

    def add(fn: Query) -> Query:
        _QUERIES[name] = fn
        if oracle:
            _ORACLES[name] = oracle
        return fn

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    return dict(_ORACLES)
