"""Listings of places: texts of "Field: value" lines, filtered by what a question asks of a place; and what comes with the documents they are from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import tokens
from siltstone.operators.coverage import found

# Lines that describe a place itself, words of a question that ask for listings in general, and words that rule a name out.
DESCRIBING = ("Place", "Type", "Cuisine", "Description", "Address", "Vegan", "Brand")
ASKING = ("listing", "listings", "stop", "stops", "visit", "visits", "trip", "suggest", "re", "ll", "ve", "s", "t", "d", "m")
RULING = ("not", "no", "avoid", "avoiding", "except", "other than", "rather than", "instead of")
_PACKAGE = r"Lua error in package\.lua at line \d+: [^.]*\.\s*"
_SCRIPT = r"Lua error in \S+ at line \d+: [^.()]*(?:\([^)]*\))?\."
FLOOR = 0.68


def value(text: Column, field: str) -> Column:
    """What the first line of a field says, null without one or with an empty one."""
    return F.nullif(F.trim(F.regexp_extract(text, rf"(?m)^{field}: (.*)$", 1)), F.lit(""))


def of_categories(rows: DataFrame, categories: Sequence[str], column: str | None = None, text: str = "text") -> DataFrame:
    """Rows of the categories: by the column that holds them, and where it is null or there is none by the text's own line."""
    line = F.lower(value(F.col(text), "Category"))
    own = F.coalesce(F.lower(column), line) if column else line
    return rows.where(own.isin(*(c.lower() for c in categories)))


def above(rows: DataFrame, floor: float = FLOOR, score: str = "score") -> DataFrame:
    """Hits whose similarity reaches the floor; those without one don't."""
    return rows.where(F.col(score) >= floor)


def left_out(question: Column) -> Column:
    """Names that a question rules out ("an ATM, not Euronet"), in lower case: a capitalised word of three letters or more after one of RULING."""
    before = "|".join(f"[{w[0].upper()}{w[0]}]{w[1:]}" for w in RULING)
    said = rf"\b(?:{before})\s+(?:(?:an?|the)\s+)?(\p{{Lu}}[\p{{L}}&'-]{{2,}})"
    return F.transform(F.regexp_extract_all(question, F.lit(said), F.lit(1)), lambda n: F.lower(n))


def kept(rows: DataFrame, question: str = "question", name: str = "name") -> DataFrame:
    """Rows whose name holds none of the names that their question rules out."""
    return rows.where(~F.exists(left_out(F.coalesce(question, F.lit(""))), lambda n: F.contains(F.lower(F.coalesce(name, F.lit(""))), n)))


def fits(text: Column, terms: Column) -> Column:
    """Whether the lines that describe a place hold a term of the question, those of its destination and general ones aside. Without any other term every place fits."""
    town = tokens(F.coalesce(value(text, "Destination"), F.lit("")))
    own = F.filter(terms, lambda t: ~t.isin(*ASKING) & ~F.array_contains(town, t))
    said = tokens(F.concat_ws(" ", *(value(text, f) for f in DESCRIBING)))
    return (F.size(own) == 0) | (found(said, own) > 0)


def uncovered(documents: DataFrame, provenance: DataFrame, key: str = "document_id", metadata: str = "metadata", most: int = 1 << 20) -> DataFrame:
    """(key, problem): documents without a row of provenance, rows without a document, documents with several, and metadata that is null, empty, longer than `most` bytes or no JSON object. A complete provenance has none."""
    asked = documents.select(F.col(key).alias("_asked")).distinct()
    told = provenance.groupBy(F.col(key).alias("_told")).agg(F.count("*").alias("_n"), F.bool_and((F.octet_length(F.coalesce(metadata, F.lit(""))).between(1, most)) & F.coalesce(F.try_parse_json(metadata).isNotNull() & F.trim(metadata).startswith("{"), F.lit(False))).alias("_good"))
    both = asked.join(told, F.col("_asked") == F.col("_told"), "full")
    problem = F.when(F.col("_told").isNull(), "missing").when(F.col("_asked").isNull(), "extra").when(F.col("_n") > 1, "repeated").when(~F.col("_good"), "no metadata")
    return both.select(F.coalesce("_asked", "_told").alias(key), problem.alias("problem")).where("problem is not null")


def without_script_errors(text: Column, title: Column) -> Column:
    """A text without the errors that templates leave: those of packages go, one that opens the text gives way to the title, and sentences with another go whole."""
    bare = F.regexp_replace(text, _PACKAGE, "")
    bare = F.when(bare.rlike(f"^{_SCRIPT}"), F.concat(title, F.regexp_replace(bare, f"^{_SCRIPT}", ""))).otherwise(bare)
    parts = F.split(F.regexp_replace(bare, _SCRIPT, "\u0001"), r"(?<=[.!?])\s+")
    clean = F.trim(F.array_join(F.filter(parts, lambda p: ~F.contains(p, F.lit("\u0001"))), " "))
    return F.when(F.contains(text, F.lit("Lua error")), clean).otherwise(text)
