"""Registered queries: each takes the tables of one folder; some have the SQL that states their result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


class Tables:
    """Lazily read tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None, tables: Callable[[SparkSession, str], object] = Tables):
    """Registers a function of the tables under a name."""

    def add(f: Callable[[object], DataFrame]):
        QUERIES[name] = lambda spark, folder: f(tables(spark, folder))
        if sql:
            SQL[name] = sql
        return f

    return add
