"""How a query is bound: a function of the table loader, under a name, with DuckDB SQL written apart from it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarnbeck.sources.tables import table


class Loader:
    """Reads the tables of one folder: ``t("orders")``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


class Queries:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable:
        def bound(f: Callable[[Loader], DataFrame]) -> Callable:
            self.queries[name] = lambda spark, sf_dir: f(Loader(spark, sf_dir))
            if sql:
                self.oracles[name] = sql
            return f

        return bound
