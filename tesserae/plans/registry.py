"""Registered queries by name, the operators each one exercises, and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tesserae.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
OPERATORS: dict[str, tuple[str, ...]] = {}


class Tables:
    """The tables of one folder, read as they are asked for: `t.orders`."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = ship(spark), sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(operators: str, sql: str | None = None):
    """Register a function of Tables under its own name; `operators` lists the IDs it exercises."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        OPERATORS[f.__name__] = tuple(operators.split())
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register

