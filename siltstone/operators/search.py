"""Full-text search on DataFrames. Higher scores are stronger; ties go to the smaller key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions.text import tokens

K1, B = 1.2, 0.75


def passages(docs: DataFrame) -> DataFrame:
    """(doc_id, source, title, text): the title is the first six words of the first line."""
    first = F.split(F.split("text", "\n")[0], " ")
    return docs.select("doc_id", "source", F.array_join(F.slice(first, 1, 6), " ").alias("title"), "text")


def postings(docs: DataFrame, key: str, text: str, terms: Sequence[str] | None = None) -> DataFrame:
    """(key, term, tf, words): the terms given, or all, with each document's length. The filter comes before the shuffle."""
    words = docs.select(key, tokens(F.col(text)).alias("_w")).withColumn("words", F.size("_w"))
    kept = F.filter("_w", lambda w: w.isin(*terms)) if terms is not None else F.col("_w")
    return words.select(key, "words", F.explode(kept).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("words").alias("words"))


def bm25(docs: DataFrame, query: Sequence[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of documents that hold a term. Lengths and counts are read in one pass over the text; only matching rows are shuffled."""
    terms = list(dict.fromkeys(query))
    words = docs.select(key, tokens(F.col(text)).alias("_w"))
    n, total = words.agg(F.count("*"), F.sum(F.size("_w"))).first()
    average = max(1.0, (total or 0) / max(1, n))
    counts = [F.size(F.filter("_w", _is(t))).alias(f"_t{i}") for i, t in enumerate(terms)]
    hit = words.where(F.exists("_w", lambda w: w.isin(*terms))).select(key, F.size("_w").alias("_n"), *counts)
    df = hit.agg(*(F.count(F.when(F.col(f"_t{i}") > 0, 1)).alias(f"d{i}") for i in range(len(terms)))).first()
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf = F.col(f"_t{i}")
        idf = F.lit(_idf(n, df[i]))
        score = score + F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_n") / average))).otherwise(0.0)
    return hit.select(key, score.alias("score"))


def _is(term: str):
    return lambda w: w == term


def _idf(n: int, df: int) -> float:
    import math

    return math.log(1 + (n - df + 0.5) / (df + 0.5))


def top(scored: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    return scored.orderBy(F.desc("score"), key).limit(k)


def together(text: Column, query: Sequence[str], most: int = 3) -> Column:
    """How often neighbouring words of the query are neighbours in text, up to most."""
    pairs = {f"{a} {b}" for a, b in zip(query, query[1:], strict=False)}
    w = tokens(text)
    held = F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.least(F.lit(most), F.size(F.filter(held, lambda p: p.isin(*pairs))))


def title_weighted(docs: DataFrame, query: Sequence[str], weight: float = 3.0) -> DataFrame:
    """(doc_id, score): weight times the title's score and the text's."""
    named = passages(docs)
    both = bm25(named, query, text="title").select("doc_id", (F.col("score") * weight).alias("score")).unionByName(bm25(named, query))
    return both.groupBy("doc_id").agg(F.sum("score").alias("score"))


def document_frequency(docs: DataFrame, cap: int | None = None) -> DataFrame:
    """(term, df): documents that hold each term, at most cap."""
    df = F.count("*") if cap is None else F.least(F.count("*"), F.lit(cap))
    return docs.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).groupBy("term").agg(df.alias("df"))


def pool(docs: DataFrame, query: Sequence[str], limit: int) -> DataFrame:
    """(doc_id, stage, score): documents with all terms first, then those with any (three times limit), the first stage that finds a document counting."""
    terms = list(dict.fromkeys(query))
    held = F.size(F.array_intersect(tokens(F.col("text")), F.array(*map(F.lit, terms))))
    scored = bm25(docs, terms).join(docs.select("doc_id", held.alias("_held")), "doc_id")
    every = scored.where(F.col("_held") == len(terms)).orderBy(F.desc("score"), "doc_id").limit(limit).select("doc_id", F.lit(0).alias("stage"), "score")
    some = scored.orderBy(F.desc("score"), "doc_id").limit(3 * limit).select("doc_id", F.lit(1).alias("stage"), "score")
    return every.unionByName(some).groupBy("doc_id").agg(F.min("stage").alias("stage"), F.first("score").alias("score"))


def per_document(ranked: DataFrame, document: str, most: int = 2) -> DataFrame:
    """At most `most` rows of each document, in rank order."""
    place = F.row_number().over(W.partitionBy(document).orderBy("rank"))
    return ranked.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def titles(docs: DataFrame, limit: int = 5000) -> DataFrame:
    """(title, doc_id): each title with its first document, the shortest titles first."""
    return passages(docs).groupBy("title").agg(F.min("doc_id").alias("doc_id")).orderBy(F.length("title"), "doc_id").limit(limit)


def nominate(docs: DataFrame, terms: Sequence[str], most: int = 8) -> DataFrame:
    """(term, title, doc_id): for each term the shortest title that holds it, the rarest term first."""
    words = passages(docs).select("doc_id", "title", F.explode(F.array_distinct(tokens(F.col("title")))).alias("term")).where(F.col("term").isin(*terms))
    by = W.partitionBy("term")
    ranked = words.withColumn("df", F.count("*").over(by)).withColumn("_n", F.row_number().over(by.orderBy(F.length("title"), "doc_id")))
    return ranked.where("_n = 1").orderBy("df", "term").limit(most).select("term", "title", "doc_id", "df")
