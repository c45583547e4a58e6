"""Queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tapeworks.plans.views import Market, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Market], DataFrame]], Callable[[Market], DataFrame]]:
    """Registers a function of the market views under name."""

    def register(build: Callable[[Market], DataFrame]) -> Callable[[Market], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: build(Market(spark, sf_dir))
        if sql:
            SQL[name] = with_views(sql)
        return build

    return register
