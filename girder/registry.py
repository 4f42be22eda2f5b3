"""Named queries: each operator bound to the driver's tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .session import ship, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of one folder, read when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        ship(spark)

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.dir, name)


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function from Tables to a DataFrame; ``sql`` is the same in DuckDB's SQL."""

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} exists")
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return build

    return register


def load() -> None:
    """Import the modules that register queries."""
    from . import plans  # noqa: F401
