"""Name -> query and name -> SQL twin."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from tablesync.checks.views import Tables, standalone

Query = Callable[[Tables], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = standalone(sql)
        return fn

    return keep


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    return QUERIES[name](Tables(spark, folder))
