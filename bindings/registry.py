"""Where queries are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bindings.views import Views

Query = Callable[[Views], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is the same result in SQL over the same parquet tables."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def runnable(fn: Query) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fn(Views(spark, sf_dir))
