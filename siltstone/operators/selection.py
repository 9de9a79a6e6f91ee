"""Which documents of a dump make a collection of a given size: those that must be in it, then the longest of the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import nfkc
from siltstone.operators.running import summed

LEAST, MOST, LIST_LEAST = 800, 60_000, 2500
_MONTHS = "january february march april may june july august september october november december"
# Titles of pages that aren't about a subject.
JUNK = (
    r"\bdisambiguation\b", r"\bdiscography\b", r"^\d{3,4}s?$", rf"^(?:{_MONTHS.replace(' ', '|')})\s+\d", r"\(\d{4} (?:album|film|song|single|novel|election)\)$",
    r"^(?:men's |women's )?\d{4} .* (?:football|basketball|baseball|cricket|tennis|hockey) league",
)


def named(title: Column) -> Column:
    """A title as it is compared: NFKC, underlines as spaces, trimmed, lower case."""
    return F.lower(F.trim(nfkc(F.replace(title, F.lit("_"), F.lit(" ")))))


def junk(title: Column) -> Column:
    """Whether a title is one of disambiguations, discographies, years, days, single works or seasons of leagues."""
    return title.rlike("(?i)" + "|".join(JUNK))


def list_like(title: Column) -> Column:
    return title.rlike(r"(?i)^(?:list|index|outline|glossary) of ")


def worth(title: Column, size: Column) -> Column:
    """Whether a document may fill a collection up: of a middling size, about a subject, and no short list."""
    return size.between(LEAST, MOST) & ~junk(title) & ~(list_like(title) & (size < LIST_LEAST))


def within_budget(docs: DataFrame, vital: DataFrame, budget: int, key: str = "doc_id") -> DataFrame:
    """(key, size, vital, before): all documents (key, title, text) whose title is in vital (title), and of the rest those worth it, longest first, until the sizes before reach the budget. Ties go to the greater key.

    Null titles and texts count as empty. before is what the collection holds before a document, vital ones first; it is null for those. The running sum goes by ranges of the order, so no task sees all documents; the titles of vital ones join by their compared form.
    """
    wanted = vital.select(named(F.col("title")).alias("_vital")).distinct()
    sized = docs.select(key, F.coalesce("title", F.lit("")).alias("title"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("size")).withColumn("_named", named(F.col("title")))
    sized = sized.join(wanted, F.col("_named") == F.col("_vital"), "left").withColumn("vital", F.col("_vital").isNotNull())
    held = sized.where("vital").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("_held"))
    rest = summed(sized.where(~F.col("vital") & worth(F.col("title"), F.col("size"))).select(key, "size", "vital"), [F.desc("size"), F.desc(key)], "size", "_before")
    rest = rest.join(F.broadcast(held)).withColumn("before", F.col("_held") + F.col("_before")).where(F.col("before") < budget)  # one row beside each
    return sized.where("vital").select(key, "size", "vital", F.lit(None).cast("long").alias("before")).unionByName(rest.select(key, "size", "vital", "before"))
