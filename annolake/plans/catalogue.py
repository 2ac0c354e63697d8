"""Named queries on the driver's tables, with the SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir) under a name."""

    def put(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE_SQL[name] = sql
        return function

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shifted(i: int) -> Column:
    """A vector's component plus 1, added as floats as the SQL does (a plain 1 makes Spark add doubles, which round to other whole numbers)."""
    return (F.col("embedding")[i] + F.lit(1).cast("float")).cast("double")
