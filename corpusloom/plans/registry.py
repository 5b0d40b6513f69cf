"""Where the plan modules register a query together with its SQL check."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        if name in QUERIES:
            raise ValueError(f"Query {name} is registered twice.")
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return register


@contextmanager
def low_limits(spark: SparkSession, rows: int):
    """Send tables of any size down the paths for hot groups while a plan is built."""
    names = ("corpusloom.hotRows", "corpusloom.smallSideRows")
    before = {name: spark.conf.get(name, None) for name in names}
    try:
        for name in names:
            spark.conf.set(name, str(rows))
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
