"""Named queries over the driver tables, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def query(self, key: str, sql: str | None = None) -> Callable[[Query], Query]:
        """Register a query; without ``sql`` only its rows can be checked."""

        def add(fn: Query) -> Query:
            if key in self.queries:
                raise ValueError(f"query {key!r} registered twice")
            self.queries[key] = fn
            if sql is not None:
                self.oracles[key] = sql
            return fn

        return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
