"""Queries by name, each with its statement for DuckDB where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import Tables, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, run: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
    """Register run over the tables, and the SQL that gives the same rows."""
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = lambda spark, sf_dir: run(Tables(spark, sf_dir))
    if sql is not None:
        ORACLES[name] = oracle(sql)
