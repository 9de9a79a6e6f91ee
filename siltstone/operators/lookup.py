"""Lookups made of the other operators: articles by title, events, phrases, sources of an answer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions.relevance import hits
from siltstone.functions.text import tokens


def titled(passages: DataFrame, phrase: str, limit: int, anchored: bool = False) -> DataFrame:
    """Passages whose title holds (or begins with) all words of the phrase in a row, the shortest titles first."""
    title = F.concat(F.lit(" "), F.array_join(tokens(F.col("title")), " "), F.lit(" "))
    words = f" {' '.join(phrase.lower().split())} "
    return passages.where(title.startswith(words) if anchored else F.contains(title, F.lit(words))).orderBy(F.length("title"), "doc_id").limit(limit)


def article(passages: DataFrame, page: str, limit: int, key: str = "document_id", order: str = "n") -> DataFrame:
    """A page's passages in order."""
    return passages.where(F.col(key).startswith(page)).orderBy(order).limit(limit)


def event_leads(passages: DataFrame, year: str, kind: str, terms: Sequence[str], limit: int) -> DataFrame:
    """Passages with a year and a kind of event in the title and all terms in the text; titles that only extend another's go. The most hits come first, then the shortest title."""
    found = passages.where(F.contains("title", F.lit(year)) & F.contains(F.lower("title"), F.lit(kind.lower()))).withColumn("hits", hits(F.col("text"), terms)).where(F.col("hits") == len(set(terms)))
    shorter = found.select(F.col("title").alias("_short")).distinct()
    own = found.join(shorter, F.col("title").startswith(F.col("_short")) & (F.col("title") != F.col("_short")), "left_anti")
    return own.orderBy(F.desc("hits"), F.length("title"), "doc_id").limit(limit)


def phrases(lines: DataFrame, asked: Sequence[str], near: dict[str, str] | None = None, limit: int = 5) -> DataFrame:
    """lines(phrase, translation) that match every asked word, itself (1) or by a near-synonym (0.75): the best score first, then the shorter phrase."""
    near = near or {}
    words = tokens(F.col("phrase"))
    score = F.lit(0.0)
    every = F.lit(True)
    for w in asked:
        own = F.when(F.array_contains(words, w), 1.0)
        own = own.when(F.array_contains(words, near[w]), 0.75).otherwise(0.0) if w in near else own.otherwise(0.0)
        score, every = score + own, every & (own > 0)
    return lines.where(every).withColumn("score", score).orderBy(F.desc("score"), F.size(words), F.length("phrase"), "phrase").limit(limit)


def unanimous(records: DataFrame, record: str, value: str, most: int = 20) -> DataFrame:
    """(record, value) of records that all say one thing; null where they differ, or where there are `most` or more."""
    return records.groupBy(record).agg(F.when((F.countDistinct(value) == 1) & (F.count("*") < most), F.min(value)).alias(value))


def cited_first(sources: DataFrame, answer: str, group: str) -> DataFrame:
    """sources(group, n, answer) with place: those that the answer cites as [n] come first, in the order of first citation, then the rest in their own."""
    at = F.instr(F.col(answer), F.concat(F.lit("["), F.col("n").cast("string"), F.lit("]")))
    return sources.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(F.when(at > 0, 0).otherwise(1), F.when(at > 0, at), "n")))


def uncovered(subjects: DataFrame, evidence: DataFrame, subject: str, text: str) -> DataFrame:
    """(question, subject) of subjects that no passage of their question names."""
    pair = subjects.join(evidence.withColumnRenamed("question", "_q"), (F.col("question") == F.col("_q")) & F.contains(F.lower(text), F.lower(subject)), "left_anti")
    return pair.select("question", subject)


def carried(previous: DataFrame, current: DataFrame, key: str, most: int = 3) -> DataFrame:
    """Up to `most` rows of earlier evidence ahead of the current, each once; rows have a rank."""
    lead = previous.where(F.col("rank") <= most).select(key, F.lit(0).alias("tier"), "rank")
    both = lead.unionByName(current.select(key, F.lit(1).alias("tier"), "rank"))
    first = both.groupBy(key).agg(F.min(F.struct("tier", "rank")).alias("p"))
    return first.select(key, F.row_number().over(W.orderBy("p.tier", "p.rank", key)).alias("rank"))
