"""Ranked lists of several collections put together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def relative(runs: DataFrame, pack: str = "pack") -> DataFrame:
    """runs with shift: how far a score lies below the best of its collection."""
    return runs.withColumn("shift", F.max("score").over(W.partitionBy(pack)) - F.col("score"))


def round_robin(runs: DataFrame, pack: str = "pack", key: str = "doc_id", by: Sequence[str] = (), keep: int = 1000) -> DataFrame:
    """runs with turn: the best of every collection, then the second of every one; of each question, where `by` names its columns. Only the `keep` best rows of a collection enter."""
    place = F.row_number().over(W.partitionBy(*by, pack).orderBy(F.desc("score"), key))
    return runs.withColumn("place", place).where(F.col("place") <= keep).withColumn("turn", F.row_number().over(W.partitionBy(*by).orderBy("place", pack)))


def merge(runs: DataFrame, limit: int | Column, keep: int = 50, pack: str = "pack", key: str = "doc_id", by: Sequence[str] = (), priority: Column | None = None) -> DataFrame:
    """The best of several collections: first and second places go round, third places come by shift, the rest fill by shift; the outcome is in order of shift.

    by: columns of the questions that runs answer, each merged on its own. priority: rows that come first within their collection, whose collections come first, and which lead the outcome. limit may be a column that doesn't vary within a question. Only the `keep` best rows of a collection enter, so what is ordered as a whole is small.
    """
    first = F.lit(False) if priority is None else priority
    place = F.row_number().over(W.partitionBy(*by, pack).orderBy(F.desc("_first"), F.desc("score"), key))
    best = F.max("score").over(W.partitionBy(*by, pack))
    rows = runs.withColumn("_first", first).withColumn("shift", best - F.col("score")).withColumn("place", place).where(F.col("place") <= keep)
    head = F.max(F.when(F.col("place") == 1, F.col("_first"))).over(W.partitionBy(*by, pack))
    tier = F.when(F.col("place") <= 2, F.col("place") - 1).when(F.col("place") == 3, 2).otherwise(3)
    order = [F.col("tier"), F.when(F.col("tier") < 2, F.lit(0.0)).otherwise(F.col("shift")), F.desc("_head"), F.col(pack), F.col("place")]
    rows = rows.withColumn("_head", head).withColumn("tier", tier).withColumn("_same", F.row_number().over(W.partitionBy(*by, key).orderBy(*order))).where("_same = 1")
    chosen = rows.withColumn("slot", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("slot") <= limit)
    return chosen.select(*by, pack, key, "score", "shift", "slot", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("_first"), "shift", "slot")).alias("rank"))


def fuse(vector: DataFrame, keyword: DataFrame, key: str = "doc_id", by: Sequence[str] = (), keep: int = 1000) -> DataFrame:
    """Vector hits ahead of keyword hits, each in its own order; a keyword hit that is a vector hit too goes. The `keep` best of each enter."""
    best = lambda hits, tier: hits.select(*by, key, F.lit(tier).alias("tier"), F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), key)).alias("place")).where(F.col("place") <= keep)
    first = best(vector, 0)
    rest = best(keyword, 1).join(first.select(*by, key), [*by, key], "left_anti")
    return first.unionByName(rest).select(*by, key, "tier", F.row_number().over(W.partitionBy(*by).orderBy("tier", "place")).alias("rank"))


def one_each(rows: DataFrame, brand, order: list) -> DataFrame:
    """The first row, by order, of each brand."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(brand).orderBy(*order))).where("_n = 1").drop("_n")


def spread(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """n rows of each group, evenly spread over its order, the first and last included; all of a smaller group."""
    w = W.partitionBy(group)
    rows = rows.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_m", F.count("*").over(w))
    step = F.sequence(F.lit(0), F.lit(n - 1))
    picks = F.transform(step, lambda j: F.floor(j * (F.col("_m") - 1) / F.lit(max(1, n - 1))).cast("int"))
    return rows.where((F.col("_m") <= n) | F.array_contains(picks, F.col("_i"))).drop("_i", "_m")
