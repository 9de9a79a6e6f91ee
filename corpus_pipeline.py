"""The corpus pipeline: stages from raw documents to packed training sequences. Each stage is one operator of siltstone.llm over all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import decontam, lines, packing, simhash, toxicity
from siltstone.llm.common import materialise, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go, judged by their text alone: null and empty texts, null ids and repeated rows like any other. It learns from the labelled rows of docs outside the held-out third."""
    return toxicity.rejected(docs, toxicity.learned(docs, table(spark, sf_dir, "labels")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines like an earlier document's or line's go; n_chars follows the text. Null texts and rows with null ids stay as they are; documents whose lines all go keep an empty text."""
    return lines.deduplicate(docs, counts=False, length="n_chars")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays; null and empty texts are near-duplicates of one another, of equal rows one stays, rows with null ids stay."""
    return simhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts hold none. All columns stay, whatever their names; no rows give no rows."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences."""
    return packing.pack_documents(docs, cached=250_000)  # the workers of earlier stages live on, and hold memory


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_dedup", drop_copies), ("decontamination", drop_leaks), ("packing", pack)]
#: Fingerprint links, alignment and tokenisation are beyond SQL; tests hold the result against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
