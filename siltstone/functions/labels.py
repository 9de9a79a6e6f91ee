"""Labels and near spellings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def heading_parts(title: Column) -> Column:
    """struct(article, section): a title cut at its first " — " or, without one, at " - "; section is null without either."""
    dash = F.when(title.contains(" — "), F.lit(" — ")).when(title.contains(" - "), F.lit(" - "))
    at = F.when(dash.isNotNull(), F.locate(" — ", F.when(title.contains(" — "), title).otherwise(F.replace(title, F.lit(" - "), F.lit(" — ")))))
    return F.struct(
        F.when(dash.isNull(), F.trim(title)).otherwise(F.trim(F.substring(title, F.lit(1), at - 1))).alias("article"),
        F.when(dash.isNotNull(), F.trim(F.substring(title, at + 3, F.length(title)))).alias("section"),
    )


def heading_path(title: Column) -> Column:
    """struct(article, above, own): a title cut at its first " — " into its article and the headings after it, those joined by " > "; own is the last of them, above the ones over it. Null and empty without any."""
    parts = heading_parts(title)
    path = F.transform(F.split(F.coalesce(parts["section"], F.lit("")), " > "), lambda p: F.trim(p))
    some = F.filter(path, lambda p: p != "")
    return F.struct(parts["article"].alias("article"), F.slice(some, F.lit(1), F.greatest(F.size(some) - 1, F.lit(0))).alias("above"), F.get(some, F.size(some) - 1).alias("own"))


def page_ranges(pages: Column) -> Column:
    """"1–3, 7": the runs of an array of page numbers, sorted, each once."""
    sorted_ = F.array_sort(F.array_distinct(F.filter(pages, lambda p: p.isNotNull())))
    starts = F.filter(sorted_, lambda p: ~F.array_contains(sorted_, p - 1))
    ends = F.filter(sorted_, lambda p: ~F.array_contains(sorted_, p + 1))
    return F.array_join(F.zip_with(starts, ends, lambda a, z: F.when(a == z, a.cast("string")).otherwise(F.concat(a.cast("string"), F.lit("–"), z.cast("string")))), ", ")


def within_edits(a: Column, b: Column, cap: int) -> Column:
    """Edit distance of a and b up to cap, cap + 1 beyond it."""
    d = F.levenshtein(a, b, cap)
    return F.when(d < 0, F.lit(cap + 1)).otherwise(d)
