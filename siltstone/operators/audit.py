"""Checks between tables: duplicates, orphans, coverage, equality, digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, n) of keys that occur more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def conflicts(rows: DataFrame, key: str, content: str) -> DataFrame:
    """(key, copies, versions): versions over 1 is one id with different contents. The contents meet as digests."""
    return rows.groupBy(key).agg(F.count("*").alias("copies"), F.countDistinct(F.sha2(content, 256)).alias("versions"))


def consolidate(rows: DataFrame, key: str, content: str) -> DataFrame:
    """rows without exact repeats; raises if one id has different contents."""
    bad = conflicts(rows, key, content).where("versions > 1").limit(5).collect()
    if bad:
        raise ValueError(f"one id with different contents: {[r[0] for r in bad]}")
    return rows.dropDuplicates([key])


def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(problem, n): repeated, missing and unmatched keys between two tables that should hold the same."""
    of = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n")
    keys = right.select(key)
    return of(duplicates(left, key), "repeated").unionByName(of(keys.join(left, key, "left_anti"), "missing")).unionByName(of(left.join(keys, key, "left_anti"), "unmatched"))


def differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): rows that the other table lacks or has otherwise."""
    a, b = left.alias("a"), right.alias("b")
    same = F.lit(True)
    for c in left.columns:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    side = F.when(F.col(f"b.{key}").isNull(), "left").when(F.col(f"a.{key}").isNull(), "right").otherwise("changed")
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").where(~same | F.col(f"a.{key}").isNull() | F.col(f"b.{key}").isNull()).select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), side.alias("side"))


def digest(rows: DataFrame, *columns: str) -> DataFrame:
    """(n, digest) that doesn't depend on the order of rows; partial sums meet, not rows."""
    h = F.conv(F.left(F.sha2(F.to_json(F.struct(*columns)), 256), F.lit(12)), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.count("*").alias("n"), F.sum(h).alias("digest"))
