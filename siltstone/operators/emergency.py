"""Emergency numbers of countries, from tables whose first columns are country, police, ambulance and fire, with notes after them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SERVICES = ("police", "ambulance", "fire")
# Labels of numbers in notes.
LABELS = {"Police": "police", "Ambulance": "ambulance", "Fire": "fire", "Fire brigade": "fire", "Fire department": "fire", "Emergency": "general", "Mobile phones": "mobile"}
_NUMBER = r"(?:\(\+\d+\)\s*)?\d(?:[\d\- ]*\d)?"
_NUMBERS = rf"{_NUMBER}(?:\s*(?:\bor\b|\band\b|/|,)\s*{_NUMBER})*"
#: A label begins the notes or follows the end of a clause, so that "Non-emergency police – 101" gives nothing.
_NOTE = rf"(?:^\s*|(?<=[;.,:)\]\d]\s{{0,9}}))({'|'.join(sorted(LABELS, key=len, reverse=True))})\s*[–-]\s*({_NUMBERS})"


def _split(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(_NUMBER), F.lit(0)), lambda n: F.trim(n))


def listed(text: Column) -> Column:
    """The numbers of a cell that holds nothing but numbers joined by or, and, a slash or a comma; null for any other text, none for an empty cell."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).when(text.rlike(f"^(?:{_NUMBERS})$"), _split(text))


def noted(notes: Column, service: str) -> Column:
    """The numbers that notes give a service under one of its labels ("Police – 110")."""
    names = [k for k, v in LABELS.items() if v == service]
    found = F.regexp_extract_all(notes, F.lit(_NOTE), F.lit(0))
    own = F.filter(found, lambda m: F.regexp_extract(m, _NOTE.replace(r"(?:^\s*|(?<=[;.,:)\]\d]\s{0,9}))", r"^\s*"), 1).isin(*names))
    return F.flatten(F.transform(own, lambda m: _split(F.regexp_extract(m, rf"[–-]\s*({_NUMBERS})$", 1))))


def numbers(rows: DataFrame, codes: DataFrame, key: str = "page_id") -> DataFrame:
    """(code, name, region, police, ambulance, fire, general, mobile, unread): a row for each country, of table rows (sources.html.table_rows) and codes (name, code).

    Tables of class wikitable only. Numbers keep their first place and count once. A cell across all three services is the general number too. unread names the services whose cell holds more than numbers. Countries without a code are left out. A table with another header, and two rows for a code that differ, stop the job.
    """
    rows = rows.where(F.array_contains("classes", "wikitable"))
    head = F.transform(F.slice("cells", 1, 4), F.lower)
    good = (F.col("row") > 0) | (head == F.array(*map(F.lit, ("country", *SERVICES))))
    rows = rows.where(F.when(good, F.col("row") > 0).otherwise(F.raise_error(F.concat(F.lit("not a table of numbers: "), F.array_join("cells", "|"))).cast("boolean")))
    cell = lambda n: F.coalesce(F.get("cells", F.lit(n)), F.lit(""))
    whole = F.get("widths", F.lit(1)) == 3
    notes = F.when(F.size("cells") > 4, cell(4)).otherwise("")
    own = {s: listed(cell(n + 1)) for n, s in enumerate(SERVICES)}
    none = F.array().cast("array<string>")
    every = {s: F.array_distinct(F.concat(F.coalesce(own[s], none), noted(notes, s))) for s in SERVICES}
    general = F.array_distinct(F.concat(F.when(whole, F.coalesce(own["police"], none)).otherwise(none), noted(notes, "general")))
    unread = F.filter(F.array(*(F.when(own[s].isNull(), F.lit(s)) for s in SERVICES)), lambda x: x.isNotNull())
    entry = rows.select(cell(0).alias("name"), F.col("heading").alias("region"), *(v.alias(s) for s, v in every.items()), general.alias("general"), noted(notes, "mobile").alias("mobile"), unread.alias("unread"), F.struct(key, "n", "row").alias("_at"))
    known = codes.select(F.lower("name").alias("_name"), "code")
    entry = entry.join(known, F.lower("name") == F.col("_name")).drop("_name")
    told = F.struct("name", *SERVICES, "general", "mobile", "unread")
    entry = entry.withColumn("_told", told)
    best = entry.groupBy("code").agg(F.min_by(F.struct("name", "region", *SERVICES, "general", "mobile", "unread"), "_at").alias("e"), F.min("_told").alias("_a"), F.max("_told").alias("_z"))
    sure = F.when(F.col("_a") == F.col("_z"), F.col("code")).otherwise(F.raise_error(F.concat(F.lit("rows that differ for "), F.col("code"))).cast("string"))
    return best.select(sure.alias("code"), "e.*")
