"""Named queries: name -> (callable of session and folder, equivalent SQL or none)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..session import ship

Run = Callable[[SparkSession, str], DataFrame]


def ready(spark: SparkSession) -> SparkSession:
    ship(spark)
    return spark


class Tables:
    """The tables of a folder, read on demand: ``t.orders``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self._folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._folder}/{name}.parquet")


@dataclass
class Registry:
    runs: dict[str, Run] = field(default_factory=dict)
    sqls: dict[str, str] = field(default_factory=dict)

    def query(self, name: str, sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
        """Registers a function of Tables. sql: what DuckDB must return on the same tables."""

        def add(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
            if name in self.runs:
                raise ValueError(f"query {name} is already registered")
            self.runs[name] = lambda spark, folder: fn(Tables(ready(spark), folder))
            if sql:
                self.sqls[name] = sql
            return fn

        return add
