"""Conversations: topics, search, runs of lines under a header."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def topics(turns: DataFrame, topic: str, order: str) -> DataFrame:
    """(topic, turns, first, latest): turns under each topic, the topic of the latest turn first; turns without a topic are topics of their own, by their order."""
    key = F.coalesce(F.col(topic).cast("string"), F.concat(F.lit("@"), F.col(order).cast("string")))
    return turns.groupBy(key.alias("topic")).agg(F.count("*").alias("turns"), F.min(order).alias("first"), F.max(order).alias("latest")).orderBy(F.desc("latest"), "topic")


def search(turns: DataFrame, text: str, words: Sequence[str]) -> DataFrame:
    """turns whose text holds every word, whatever the case."""
    held = F.lit(True)
    for w in words:
        held = held & F.contains(F.lower(text), F.lit(w.lower()))
    return turns.where(held)


def runs(rows: DataFrame, group: str, order: str, header: Column) -> DataFrame:
    """rows with run: rows belong to the latest header at or before them, 0 before the first."""
    return rows.withColumn("run", F.sum(header.cast("int")).over(W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def follow_ups(turns: DataFrame, conversation: str, order: str, text: str, most: int = 6) -> DataFrame:
    """turns with context: the text before, where a turn is so short that it leans on it."""
    before = F.lag(text).over(W.partitionBy(conversation).orderBy(order))
    return turns.withColumn("context", F.when(F.size(F.split(F.trim(text), r"\s+")) <= most, before))
