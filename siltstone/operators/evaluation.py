"""Scores of answers and of retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_category(results: DataFrame, category: str, score: str) -> DataFrame:
    """(category, n, mean), and the same over all as category "all"; means are rounded half to even at six places."""
    every = results.agg(F.count("*").alias("n"), F.avg(score).alias("mean")).select(F.lit("all").alias("category"), "n", F.bround("mean", 6).alias("mean"))
    return results.groupBy(category).agg(F.count("*").alias("n"), F.avg(score).alias("mean")).select(F.col(category).alias("category"), "n", F.bround("mean", 6).alias("mean")).unionByName(every)


def ratio(results: DataFrame, group: str, measured: str, baseline: str) -> DataFrame:
    """(group, ratio) of two means; null where the baseline's is 0."""
    return results.groupBy(group).agg(F.bround(F.avg(measured) / F.nullif(F.avg(baseline), F.lit(0.0)), 6).alias("ratio"))


def hits(ranked: DataFrame, gold: DataFrame, query: str, item: str) -> DataFrame:
    """(query, hit_1, hit_5, missing): whether a gold item is first, or among five; how many were not found at all. ranked has a rank from 1."""
    joined = gold.join(ranked, [query, item], "left")
    return joined.groupBy(query).agg(F.coalesce(F.bool_or(F.col("rank") == 1), F.lit(False)).alias("hit_1"), F.coalesce(F.bool_or(F.col("rank") <= 5), F.lit(False)).alias("hit_5"), F.count(F.when(F.col("rank").isNull(), 1)).alias("missing"))


def reader(items: DataFrame) -> DataFrame:
    """items(category, answerable, correct, refused, words): (category, n, correct, gaps, false_refusals, median_words). correct is over answerable items; gaps is the share of unanswerable ones refused."""
    yes, no = F.col("answerable"), ~F.col("answerable")
    share = lambda flag, of: F.bround(F.avg(F.when(of, flag.cast("double"))), 6)
    return items.groupBy("category").agg(F.count("*").alias("n"), share(F.col("correct"), yes).alias("correct"), share(F.col("refused"), no).alias("gaps"), share(F.col("refused"), yes).alias("false_refusals"), F.median("words").alias("median_words"))


def paired(first: DataFrame, second: DataFrame, keys: list[str], score: str) -> DataFrame:
    """(keys, first, second, change) of two runs over the same keys; raises if the keys differ."""
    a, b = first.select(*keys), second.select(*keys)
    if a.exceptAll(b).limit(1).count() or b.exceptAll(a).limit(1).count():
        raise ValueError("the runs have different keys")
    return first.select(*keys, F.col(score).alias("first")).join(second.select(*keys, F.col(score).alias("second")), keys).withColumn("change", F.col("second") - F.col("first"))
