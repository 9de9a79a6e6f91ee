"""Incremental ingest: new files of documents become passages once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from siltstone.operators.chunking import chunk


def documents(spark: SparkSession, path: str, schema, form: str = "parquet") -> DataFrame:
    return spark.readStream.format(form).schema(schema).load(path)


def ingest(stream: DataFrame, out: str, checkpoint: str, key: str = "doc_id", once: bool = True) -> StreamingQuery:
    """Cuts every new document of the stream into passages and appends them to out as Parquet; documents that come again under an id already seen are left out. With once, reads what is there and ends. Stopped runs go on from the checkpoint, and each file counts exactly once."""
    passages = chunk(stream.dropDuplicates([key]), key=key)
    writer = passages.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def activity(events: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """(window, event_type, n, value) of an event stream, with a watermark for late rows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
