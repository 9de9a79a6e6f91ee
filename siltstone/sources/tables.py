"""The engine's tables, read with the columns a query needs, and tables written between steps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder under the warehouse where all of Spark is one process; elsewhere an unset folder is an error."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not given and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return given or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as written to the shared folder and read back, so that each reader sees the same rows whatever is lost meanwhile. The files go when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/siltstone-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """df dealt to as many tasks as Spark's shuffles have, where each row is much work: a file of few bytes is read by one task however many rows it holds."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
