"""A section of the catalog: named queries and their SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.readers import spread_rows


class Tables:
    """The driver's parquet tables of one scale factor, read lazily."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


    def wide(self, name: str) -> DataFrame:
        """The table spread over all cores, for work that is heavy per row."""
        return spread_rows(getattr(self, name))


class Book:
    def __init__(self):
        self.runs: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def register(fn: Callable[[Tables], DataFrame]):
            self.runs[name] = lambda spark, folder: fn(Tables(spark, folder))
            if sql:
                self.sql[name] = sql
            return fn
        return register
