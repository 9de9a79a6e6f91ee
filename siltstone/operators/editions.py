"""Catalogues and editions: what may be offered and what is newer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parts(edition: Column) -> Column:
    """The dotted numbers of an edition."""
    return F.transform(F.split(F.regexp_extract(edition, r"^\d+(?:\.\d+)*", 0), r"\."), lambda x: x.cast("bigint"))


def suffix(edition: Column) -> Column:
    """What follows the numbers, without the hyphen; empty if nothing does."""
    return F.regexp_replace(F.regexp_replace(edition, r"^\d+(?:\.\d+)*", ""), "^-", "")


def compare(left: Column, right: Column) -> Column:
    """-1, 0 or 1; null if the editions can't be compared: one has no numbers, or equal numbers have two different suffixes that aren't previews. A preview comes before its release, a rebuild (other suffix) after it. Missing numbers count as 0."""
    a, b = parts(left), parts(right)
    longest = F.greatest(F.size(a), F.size(b))
    pad = lambda x: F.transform(F.sequence(F.lit(0), longest - 1), lambda i: F.coalesce(F.get(x, i), F.lit(0).cast("bigint")))
    numbers = F.when(pad(a) < pad(b), -1).when(pad(a) > pad(b), 1).otherwise(0)
    rank = lambda s: F.when(s == "preview", 0).when(s == "", 1).otherwise(2)
    p, q = suffix(left), suffix(right)
    by_suffix = F.when(p == q, 0).when(rank(p) < rank(q), -1).when(rank(p) > rank(q), 1)
    valid = left.rlike(r"^\d") & right.rlike(r"^\d")
    return F.when(valid, F.when(numbers != 0, numbers).otherwise(by_suffix))


def offers(catalogue: DataFrame, installed: DataFrame) -> DataFrame:
    """catalogue(id, version) against installed(id, version), with offer: "new" if no edition is installed, "update" if it is newer than every one that is. The rest is left out; incomparable is not newer."""
    have = installed.select(F.col("id").alias("_id"), F.col("version").alias("_version"))
    joined = catalogue.join(have, F.col("id") == F.col("_id"), "left")
    newer = F.coalesce(compare(F.col("version"), F.col("_version")) > 0, F.lit(False))
    found = joined.groupBy("id", "version").agg(F.count("_id").alias("_n"), F.bool_and(newer).alias("_newer"))
    return found.select("id", "version", F.when(F.col("_n") == 0, "new").when(F.col("_newer"), "update").alias("offer")).where("offer is not null")
