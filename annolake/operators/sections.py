"""Joining positions to the headings that govern them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def carry_forward(rows: DataFrame, partition: list[str], order: list, is_mark: Column, value: Column, out: str) -> DataFrame:
    """Backward as-of join of a table with itself: each row gets the value of the last mark at or before it."""
    window = W.partitionBy(*partition).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn(out, F.last(F.when(is_mark, value), ignorenulls=True).over(window))
