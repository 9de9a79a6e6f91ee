"""Ways to read part of a table: ranges of keys, first and last rows, rows that exist, rows of enabled collections, and joins that must match one to one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_range(rows: DataFrame, key: str, low, high) -> DataFrame:
    """Rows with low <= key < high; the bounds reach the scan."""
    return rows.where((F.col(key) >= F.lit(low)) & (F.col(key) < F.lit(high)))


def ends(rows: DataFrame, group: str, order: str) -> DataFrame:
    """(group, first, last): the least and greatest order of each group, found by partial minima."""
    return rows.groupBy(group).agg(F.min(order).alias("first"), F.max(order).alias("last"))


def exists(rows: DataFrame, condition: Column, key: str, limit: int = 40) -> DataFrame:
    """(key, found): for each key whether a row meets the condition; found counts them up to limit."""
    return rows.groupBy(key).agg(F.least(F.sum(F.when(condition, 1).otherwise(0)), F.lit(limit)).cast("long").alias("found"))


def enabled(rows: DataFrame, collections: DataFrame, key: str) -> DataFrame:
    """Rows of collections that are listed."""
    return rows.join(collections.select(key).distinct(), key, "left_semi")


def one_to_one(asked: DataFrame, answered: DataFrame, key: str) -> DataFrame:
    """(problem, n): questions without a result, results without a question, and keys answered more than once."""
    of = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n")
    again = answered.groupBy(key).count().where("count > 1")
    return of(asked.join(answered, key, "left_anti"), "missing").unionByName(of(answered.join(asked, key, "left_anti"), "extra")).unionByName(of(again, "repeated"))
