"""Where the checks register themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

queries: dict[str, Query] = {}
oracles: dict[str, str] = {}


def check(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        if name in queries:
            raise ValueError(f"check {name} is registered twice")
        queries[name] = function
        if sql is not None:
            oracles[name] = sql
        return function

    return register
