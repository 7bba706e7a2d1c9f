"""Registered queries: a name, a plan builder and the same query as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mediaspan.plans.catalog import PRELUDE, Library

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, plan: Callable[[Library], DataFrame], sql: str | None = None) -> None:
    """plan takes the library of a folder; sql is one SELECT over the prelude's views."""
    QUERIES[name] = lambda spark, sf_dir: plan(Library(spark, sf_dir))
    if sql is not None:
        ORACLES[name] = PRELUDE + sql


def query(name: str, sql: str | None = None) -> Callable:
    def keep(plan: Callable[[Library], DataFrame]) -> Callable:
        register(name, plan, sql)
        return plan

    return keep
