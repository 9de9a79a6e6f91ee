"""Ordered rules over texts: the first rule that fits a text names it, in one pass over the table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A name for texts that fit every expression of `all`, one of `any` if it has some, and none of `none`; case aside."""

    name: str
    all: tuple[str, ...] = ()
    any: tuple[str, ...] = ()
    none: tuple[str, ...] = ()

    def fits(self, text: Column) -> Column:
        said = lambda p: text.rlike(f"(?i){p}")
        out = F.lit(True)
        for p in self.all:
            out &= said(p)
        if self.any:
            out &= said("|".join(f"(?:{p})" for p in self.any))
        for p in self.none:
            out &= ~said(p)
        return out


def named(text: Column, rules: Sequence[Rule]) -> Column:
    """The name of the first rule that a text fits; null if none does, or for a null text."""
    return F.coalesce(*(F.when(r.fits(text), F.lit(r.name)) for r in rules), F.lit(None).cast("string"))


def ranked(rows: DataFrame, keywords: DataFrame, words: str, by: str) -> DataFrame:
    """(by, name, hits): for rows (by, words: an array of words), the names of keywords (name, word) with how many of their words each row holds. Words meet by equality; a word that most rows hold is split as a skewed join is."""
    held = rows.select(by, F.explode(F.array_distinct(words)).alias("_word"))
    return held.join(keywords.select("name", F.col("word").alias("_w")).distinct(), F.col("_word") == F.col("_w")).groupBy(by, "name").agg(F.count("*").alias("hits"))
