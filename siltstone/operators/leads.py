"""Leads of articles and picks of sentences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions.arrays import let
from siltstone.functions.relevance import hits

#: A sentence ends at a full stop, question or exclamation mark before white space.
SENTENCE = r"(?<=[.!?])\s+"


def sentences(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), SENTENCE), lambda s: F.length(s) > 0)


def lead(text: Column, target: int = 300, most: int = 600) -> Column:
    """The first paragraph's whole sentences until target characters are reached, never over most; null if its first sentence doesn't end or is too long."""
    first = F.split(F.trim(text), r"\n\s*\n")[0]
    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("done"))

    def step(a: Column, s: Column) -> Column:
        longer = F.when(a["out"] == "", s).otherwise(F.concat_ws(" ", a["out"], s))
        stop = a["done"] | (F.length(longer) > most) | ~s.rlike(r"[.!?]$")
        return F.when(stop, F.struct(a["out"].alias("out"), F.lit(True).alias("done"))).otherwise(F.struct(longer.alias("out"), (F.length(longer) >= target).alias("done")))

    return F.nullif(F.aggregate(sentences(first), start, step, lambda a: a["out"]), F.lit(""))


def best_sentence(rows: DataFrame, key: str, text: str, terms: Sequence[str]) -> DataFrame:
    """(key, sentence, hits): of each text the sentence with the most hits, the first of equals; texts without a hit are left out."""
    each = rows.select(key, F.posexplode(sentences(F.col(text))).alias("n", "sentence")).withColumn("hits", hits(F.col("sentence"), terms)).where("hits > 0")
    first = F.row_number().over(W.partitionBy(key).orderBy(F.desc("hits"), "n"))
    return each.withColumn("_n", first).where("_n = 1").select(key, "sentence", "hits")


def excerpt(text: Column, terms: Sequence[str], run: int = 3) -> Column:
    """The run of so many sentences that has the most hits, the first of equals."""
    def best(s: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(s) - run + 1, F.lit(1))), lambda i: F.array_join(F.slice(s, i, F.lit(run)), " "))
        return F.element_at(F.array_sort(F.transform(runs, lambda r, i: F.struct((-hits(r, terms)).alias("h"), i.alias("i"), r.alias("r")))), 1)["r"]

    return F.when(F.size(sentences(text)) > 0, let(sentences(text), best))
