"""Registry of named queries with their reference SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from synthframe.session import tune
from synthframe.sources.tables import read_table


class Tables:
    """The Parquet tables of one scale-factor folder, read on demand."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = tune(spark), folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return read_table(self.spark, f"{self.folder}/{name}.parquet")


@dataclass
class Query:
    name: str
    ids: str
    run: Callable[[Tables], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, ids: str, sql: str | None = None):
    """Register `fn(tables) -> DataFrame` under a name, with inventory ids and SQL."""
    def add(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Query(name, ids, fn, sql)
        return fn
    return add


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, folder, q=q: q.run(Tables(spark, folder))) for name, q in QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: q.sql for name, q in QUERIES.items() if q.sql}
