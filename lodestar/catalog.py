"""The registry of named queries: a callable, and an oracle in SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
ROWS: dict[str, tuple[int, ...]] = {}


def register(name: str, rows: tuple[int, ...] = (), oracle: str | None = None):
    """Decorator that names a query, the survey rows that it covers, and its oracle."""

    def keep(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are called {name}")
        QUERIES[name], ROWS[name] = fn, rows
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
