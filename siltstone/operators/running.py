"""Places and running sums over a whole table in one order, without a task that sees all rows.

Rows are cut into ranges of the order and written with the number of their range. Each range adds up what it holds; the ranges before it (one row each, so as many as there are partitions) give its offset; within a range a window does the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.sources.tables import written


def _ranged(rows: DataFrame, order: list[Column]) -> DataFrame:
    return written(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")


def _offset(parts: DataFrame, amount: Column) -> DataFrame:
    """(range, offset): what the ranges before each hold."""
    sums = parts.groupBy("_range").agg(amount.alias("_held"))
    before = F.sum("_held").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    return sums.select(F.col("_range").alias("_at"), F.coalesce(before, F.lit(0)).alias("_offset"))


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their place (from 1) in the order as a long. Rows that the order doesn't tell apart get places in any order; no rows give none."""
    parts = _ranged(rows, order)
    offset = _offset(parts, F.count("*"))
    place = F.row_number().over(W.partitionBy("_range").orderBy(*order)) + F.col("_offset")
    return parts.join(F.broadcast(offset), F.col("_range") == F.col("_at")).withColumn(name, place.cast("long")).drop("_range", "_at", "_offset")


def summed(rows: DataFrame, order: list[Column], size: str, name: str) -> DataFrame:
    """rows with the sum of the sizes of all rows before them in the order, which must tell rows apart. Null sizes count as 0."""
    parts = _ranged(rows, order)
    offset = _offset(parts, F.coalesce(F.sum(size), F.lit(0)))
    before = F.sum(size).over(W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    return parts.join(F.broadcast(offset), F.col("_range") == F.col("_at")).withColumn(name, F.coalesce(before, F.lit(0)) + F.col("_offset")).drop("_range", "_at", "_offset")
