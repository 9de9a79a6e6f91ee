"""Budgets over ordered rows: prefix fill, fill with skips, modules, running storage."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def prefix(rows: DataFrame, group: str, order: str, size: str, budget: int) -> DataFrame:
    """Rows of each group until the sizes before them reach the budget: the first that overflows is the last."""
    before = F.coalesce(F.sum(size).over(W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("used_before", before).where(F.col("used_before") < budget)


def with_skips(rows: DataFrame, group: str, order: str, size: str, budget: int) -> DataFrame:
    """Rows of each group that fit in order: one that doesn't is passed over, and smaller ones after it may still enter. A fold over each group's (order, size) pairs, in the engine."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).cast("long").alias("s"))))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{rows.schema[order].dataType.simpleString()}>").alias("kept"))
    step = lambda a, x: F.when(a["used"] + x["s"] <= budget, F.struct((a["used"] + x["s"]).alias("used"), F.array_append(a["kept"], x["o"]).alias("kept"))).otherwise(a)
    kept = rows.groupBy(group).agg(pairs.alias("_p")).select(F.col(group).alias("_g"), F.explode(F.aggregate("_p", start, step, lambda a: a["kept"])).alias("_o"))
    return rows.join(kept, (F.col(group) == F.col("_g")) & (F.col(order) == F.col("_o")), "left_semi")


def modules(rows: DataFrame, shelf: str, item: str, size: str, most: int, capacity: int) -> DataFrame:
    """(shelf, item, module): items of a shelf put into modules in order, next-fit: a module is closed once an item would bring it over `most` items or over capacity; an item is never split. Items arrive as one row each, so a shelf holds as many rows as items."""

    def fill(part: pd.DataFrame) -> pd.DataFrame:
        module, count, used, out = 0, 0, 0, []
        for name, n in part.sort_values(item)[[item, size]].itertuples(index=False):
            if count and (count + 1 > most or used + n > capacity):
                module, count, used = module + 1, 0, 0
            count, used = count + 1, used + n
            out.append((part[shelf].iloc[0], name, module))
        return pd.DataFrame(out, columns=[shelf, item, "module"])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in (shelf, item)}
    return rows.select(shelf, item, size).groupBy(shelf).applyInPandas(fill, f"{shelf} {kinds[shelf]}, {item} {kinds[item]}, module int")


def evidence(rows: DataFrame, group: str, order: str, size: str, budget: int, most: int) -> DataFrame:
    """Rows of each group with place (from 1), as long as they fit in order: one that doesn't fit is passed over, at most `most` enter. Sizes are whole and not negative; a row without size never fits.

    Groups may be of any length. Where a row enters, so did every earlier one of its size, as less was used before; so only the first `most` rows of each size within the budget can enter, and no more than most * (budget + 1) rows of a group meet. They are chosen before the shuffle as well.
    """
    first = F.row_number().over(W.partitionBy(group, size).orderBy(order))
    able = rows.where(F.col(group).isNotNull() & (F.col(size) <= budget)).withColumn("_f", first).where(F.col("_f") <= most).drop("_f")
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).cast("long").alias("s"), F.struct(*rows.columns).alias("row"))))
    whole = able.groupBy(group).agg(pairs.alias("_p"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{rows.select(F.struct(*rows.columns).alias('r')).schema['r'].dataType.simpleString()}>").alias("kept"))
    enters = lambda a, x: (a["used"] + x["s"] <= budget) & (F.size(a["kept"]) < most)
    step = lambda a, x: F.when(enters(a, x), F.struct((a["used"] + x["s"]).alias("used"), F.array_append(a["kept"], x["row"]).alias("kept"))).otherwise(a)
    kept = whole.select(F.posexplode(F.aggregate("_p", start, step, lambda a: a["kept"])).alias("_i", "_r"))
    return kept.select("_r.*", (F.col("_i") + 1).alias("place"))


def peak(rows: DataFrame, group: str, order: str, change: str) -> DataFrame:
    """(group, final, peak) of a running sum of changes."""
    running = F.sum(change).over(W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("_s", running).groupBy(group).agg(F.sum(change).alias("final"), F.max("_s").alias("peak"))
