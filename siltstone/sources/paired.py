"""Dumps of paired lines: an index line that names a record, then the record's own line.

Spark reads the lines, compressed files in splits where the format allows it. A pair may lie across two splits of a file; what a split leaves over at its ends (a record at its start, an index line at its end) is matched with its neighbour's.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.sources.tables import written

_OUT = "file string, block long, kind string, id long, record string"


def _id(value: object, what: str) -> int:
    if isinstance(value, str) and value.isdecimal():
        value = int(value)
    if isinstance(value, bool) or not isinstance(value, int) or value <= 0:
        raise ValueError(f"{what} is no positive number: {value!r}")
    return value


def _index(line: str) -> int | None:
    """The id that an index line names, None for a record's line."""
    row = json.loads(line)
    if not isinstance(row, dict):
        raise ValueError("a line holds no object")
    if "index" not in row:
        return None
    if set(row) != {"index"} or not isinstance(row["index"], dict):
        raise ValueError("an index line holds more than an index")
    return _id(row["index"].get("_id"), "the index's id")


def records(spark: SparkSession, path: str, key: str = "page_id") -> DataFrame:
    """(id, record) of the paired lines of files. An index line without its record, a record without its index line, ids that differ, and lines that are no objects stop the job."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value").where("value != ''")

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pending = None, None
        for b in batches:
            out: list[tuple] = []
            for place in zip(*(b.column(c).to_pylist() for c in ("file", "block", "value")), strict=True):
                where, line = place[:2], place[2]
                if where != at:
                    if pending is not None:
                        out.append((*at, "open", pending, None))
                    at, pending, started = where, None, False
                named = _index(line)
                if named is not None:
                    if pending is not None:
                        raise ValueError(f"index {pending} has no record")
                    pending = named
                elif pending is not None:
                    if pending != (own := _id(json.loads(line).get(key), "a record's id")):
                        raise ValueError(f"index {pending} stands before record {own}")
                    out.append((*at, "pair", pending, line))
                    pending = None
                elif not started:
                    out.append((*at, "late", _id(json.loads(line).get(key), "a record's id"), line))
                else:
                    raise ValueError("a record has no index line")
                started = True
            yield pa.RecordBatch.from_pylist([dict(zip(("file", "block", "kind", "id", "record"), r, strict=True)) for r in out], schema=_schema())
        if pending is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(("file", "block", "kind", "id", "record"), (*at, "open", pending, None), strict=True))], schema=_schema())

    found = written(lines.mapInArrow(pair, _OUT), "pairs")
    ends = found.where("kind != 'pair'")  # two rows for each split at most
    order = W.partitionBy("file").orderBy("block", F.when(F.col("kind") == "late", 0).otherwise(1))
    ends = ends.withColumn("_kind", F.lag("kind").over(order)).withColumn("_id", F.lag("id").over(order)).withColumn("_next", F.lead("kind").over(order))
    broken = F.concat(F.lit("no pair for "), F.col("id").cast("string"))
    late = (F.col("kind") == "late") & (F.coalesce("_kind", F.lit("")) == "open") & (F.col("_id") == F.col("id"))
    open_ = (F.col("kind") == "open") & (F.coalesce("_next", F.lit("")) == "late")
    ends = ends.select("id", F.when(late | open_, F.col("record")).otherwise(F.raise_error(broken).cast("string")).alias("record"))
    return found.where("kind = 'pair'").select("id", "record").unionByName(ends.where("record is not null").select("id", "record"))


def _schema() -> pa.Schema:
    return pa.schema([("file", pa.string()), ("block", pa.int64()), ("kind", pa.string()), ("id", pa.int64()), ("record", pa.string())])


def repeated(found: DataFrame) -> DataFrame:
    """Ids that more than one record has."""
    return found.groupBy("id").count().where("count > 1")
