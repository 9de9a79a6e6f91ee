"""What the operators of this package share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def bound_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Where the session has Spark's own default, batches that go to Python hold `rows` rows: texts are long, and a batch lies in memory several times."""
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset and all of Spark is one process, as in tests, a folder under the warehouse stands in; on a cluster an unset folder is an error."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given and not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return given or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


def materialise(df: DataFrame, name: str, most: int = 0) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage ends here, and a lost executor loses nothing of it. The files go when the application ends. most: rows in a file, for rows of megabytes, as a reader holds up to 4096 rows of a file at once; 0 for any number."""
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{shared_dir(spark)}/siltstone-{name}-{uuid.uuid4().hex}"
    own = spark.conf.get(CLEANUP, None)
    if own is not None:
        spark.conf.set(CLEANUP, "true")  # what is written needs its shuffles no more
    try:
        df.write.option("maxRecordsPerFile", most).parquet(path)
    finally:
        if own is not None:
            spark.conf.set(CLEANUP, own)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables that materialise() wrote and nothing reads again."""
    for df in tables:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fits(df: DataFrame, limit_rows: int, limit_bytes: int = 16_000_000) -> bool:
    """Whether df, a table that materialise() wrote, has at most limit_rows rows and limit_bytes bytes of files: the check before a broadcast."""
    path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._written)
    size = path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return size <= limit_bytes and df.count() <= limit_rows


def parts(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Slices of batches, so that what is made of one stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def rows_kept(docs: DataFrame, keep: Callable[[], Callable[[list], list[bool]]]) -> DataFrame:
    """The rows of docs that keep()(texts) keeps; keep() is called once in each task. All columns stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = keep()
        for b in parts(batches):
            yield b.filter(pa.array(of(b.column("text").to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def remainder(column: str, divisor: int):
    """crc32 of an id as text, modulo divisor."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


def components(edges: DataFrame, checkpoint: str = "components") -> DataFrame:
    """Connected components of edges (u, v). Returns (node, root): root is the smallest node of the component.

    Alternates the large-star and small-star steps. Each is a group minimum, which Spark aggregates before its shuffle, and a join back; a node with very many links is split as a skewed join is. Self links and repeated links are allowed; nulls take no part. No links: an empty result.
    """
    pairs = edges.where("u is not null and v is not null and u != v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    ).distinct()
    pairs = materialise(pairs, checkpoint)
    state = _digest(pairs)
    while state[0]:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.where("u != v").distinct(), checkpoint)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.withColumnRenamed("u", "k"), F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct(), checkpoint)
        before, state = state, _digest(pairs)
        if before == state:
            break
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _digest(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
