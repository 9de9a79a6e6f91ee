"""Records in compressed blocks of bounded size, found by key: each block is read and unpacked once however many of its records are asked for.

A folder holds `blocks` (block, n, payload, digest; in order of block) and `index` (key, block, place; in order of key). Records lie in order of key, so neighbours share blocks, and files hold ranges that Spark can pass over.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.running import summed


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (x.slice(at, 1) for x in batches for at in range(x.num_rows)):  # one block as Python objects at a time
        rows = b.column("records")[0].as_py()
        payload = zlib.compress(json.dumps(rows, ensure_ascii=False, separators=(",", ":")).encode(), 9)
        yield pa.RecordBatch.from_arrays([b.column("block"), b.column("n"), pa.array([payload], pa.binary()), b.column("keys")], ["block", "n", "payload", "keys"])


def write(records: DataFrame, path: str, key: str, record: str, size: int = 65_536) -> None:
    """Writes records (key, record) in blocks of about `size` characters; a longer record has a block of its own. Null records count as empty ones. Null keys, and keys that two records have, stop the job before anything is written."""
    twice = records.groupBy(key).count().where((F.col("count") > 1) | F.col(key).isNull()).limit(1).collect()
    if twice:
        raise ValueError(f"key {twice[0][0]!r} is null or names {twice[0][1]} records")
    rows = records.select(F.col(key).alias("key"), F.coalesce(record, F.lit("")).alias("record")).withColumn("_size", F.length("record") + 1)
    rows = summed(rows, [F.col("key")], "_size", "_before").withColumn("block", F.floor((F.col("_before") + F.col("_size") - 1) / size))
    packed = rows.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("key", "record"))).alias("rows"))
    packed = packed.select("block", F.size("rows").alias("n"), F.transform("rows", lambda r: r["record"]).alias("records"), F.transform("rows", lambda r: r["key"]).alias("keys"))
    packed = packed.mapInArrow(_packed, f"block long, n int, payload binary, keys array<{rows.schema['key'].dataType.simpleString()}>")
    packed.withColumn("digest", F.sha2("payload", 256)).repartitionByRange("block").sortWithinPartitions("block").write.parquet(f"{path}/blocks")
    held = records.sparkSession.read.parquet(f"{path}/blocks")
    index = held.select("block", F.posexplode("keys").alias("place", "key")).select("key", "block", "place")
    index.repartitionByRange("key").sortWithinPartitions("key").write.parquet(f"{path}/index")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            rows = json.loads(zlib.decompress(b.column("payload")[i].as_py()))
            wanted = b.column("wanted")[i].as_py()
            yield pa.RecordBatch.from_arrays([pa.array([w["key"] for w in wanted], b.schema.field("wanted").type.value_type.field("key").type), pa.array([rows[w["place"]] for w in wanted], pa.string())], ["key", "record"])


def lookup(spark: SparkSession, path: str, keys: DataFrame, key: str) -> DataFrame:
    """(key, record) of the keys that the blocks hold; others give no rows, and one asked for twice gives one."""
    index = spark.read.parquet(f"{path}/index")
    wanted = index.join(keys.select(F.col(key).alias("_key")).distinct(), F.col("key") == F.col("_key"), "left_semi")
    wanted = wanted.groupBy("block").agg(F.collect_list(F.struct("key", "place")).alias("wanted"))
    blocks = spark.read.parquet(f"{path}/blocks").select("block", "payload", "digest")
    sure = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("block has changed: "), F.col("block").cast("string"))).cast("binary"))
    found = blocks.join(wanted, "block").select(sure.alias("payload"), "wanted")
    kind = index.schema["key"].dataType.simpleString()
    return found.mapInArrow(_unpacked, f"key {kind}, record string").withColumnRenamed("key", key)


def compared(spark: SparkSession, path: str, source: DataFrame, key: str, record: str) -> DataFrame:
    """(records, missing, extra, different): one row that holds the blocks against their source, record by record."""
    held = lookup(spark, path, spark.read.parquet(f"{path}/index"), "key").select(F.col("key").alias("_key"), F.sha2("record", 256).alias("_held"))
    own = source.select(F.col(key).alias("_own"), F.sha2(F.coalesce(record, F.lit("")), 256).alias("_source"))
    both = own.join(held, F.col("_own") == F.col("_key"), "full")
    return both.agg(F.count("_own").alias("records"), F.count_if(F.col("_key").isNull()).alias("missing"), F.count_if(F.col("_own").isNull()).alias("extra"), F.count_if(F.col("_held") != F.col("_source")).alias("different"))
