"""Where the modules of queries register them, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(table: str, sql: str | None) -> Callable[[Callable[[DataFrame], DataFrame]], Callable]:
    """Registers a query over one table, read with its own columns only."""

    def register(f: Callable[[DataFrame], DataFrame]) -> Callable:
        return joined(sql, f.__name__)(lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/{table}.parquet"))) and f

    return register


def joined(sql: str | None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a query over several tables; without SQL it has a test of its own."""

    def register(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
