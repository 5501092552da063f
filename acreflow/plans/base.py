"""How a query and its SQL are registered together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """The tables of one directory, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def register(queries: dict, oracles: dict) -> Callable:
    """A decorator factory: ``@query("SELECT ...")`` above a function of Tables."""

    def query(sql: str | None = None) -> Callable:
        def add(body: Callable[[Tables], DataFrame]) -> Callable:
            queries[body.__name__] = lambda spark, sf_dir: body(Tables(spark, sf_dir))
            if sql:
                oracles[body.__name__] = sql
            return body

        return add

    return query
