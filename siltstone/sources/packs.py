"""Packs: a collection of passages written with its manifest and digest, and read back checked."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.audit import coverage, digest

COLUMNS = ("chunk_id", "document_id", "title", "source", "text")


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _put(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _path(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def write_pack(chunks: DataFrame, path: str, name: str, version: str, licence: str) -> dict:
    """Writes chunks as Parquet under path/chunks, sorted by id within files, and path/manifest.json last, so that a pack without one is unfinished. Returns the manifest. Repeated chunk ids and blank fields raise."""
    bad = chunks.where(" or ".join(f"{c} is null or trim({c}) = ''" for c in COLUMNS)).limit(1).count()
    if bad:
        raise ValueError("a field is blank")
    if chunks.groupBy("chunk_id").count().where("count > 1").limit(1).count():
        raise ValueError("a chunk_id is given twice")
    spark = chunks.sparkSession
    chunks.select(*COLUMNS).sortWithinPartitions("chunk_id").write.mode("overwrite").parquet(f"{path}/chunks")
    n, found = digest(spark.read.parquet(f"{path}/chunks"), *COLUMNS).first()
    manifest = {"schemaVersion": 1, "id": name, "version": version, "license": licence, "chunks": n, "digest": str(found)}
    _put(spark, f"{path}/manifest.json", json.dumps(manifest, sort_keys=True))
    return manifest


def read_pack(spark: SparkSession, path: str, verify: bool = True) -> DataFrame:
    """A pack's chunks with pack = its id; with verify the digest must be the manifest's."""
    manifest = json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/manifest.json").collect()))
    chunks = spark.read.parquet(f"{path}/chunks")
    if verify:
        n, found = digest(chunks, *COLUMNS).first()
        if (n, str(found)) != (manifest["chunks"], manifest["digest"]):
            raise ValueError(f"{manifest['id']} isn't what its manifest says")
    return chunks.withColumn("pack", F.lit(manifest["id"]))


def write_vectors(vectors: DataFrame, chunks: DataFrame, path: str) -> None:
    """Writes quantised vectors of exactly the chunks given; missing, unmatched or repeated keys raise."""
    wrong = {r["problem"]: r["n"] for r in coverage(vectors.select("chunk_id"), chunks.select("chunk_id"), "chunk_id").collect() if r["n"]}
    if wrong:
        raise ValueError(f"vectors don't cover the chunks: {wrong}")
    vectors.sortWithinPartitions("chunk_id").write.mode("overwrite").parquet(path)


def write_clusters(coded: DataFrame, path: str, key: str = "vec_id") -> None:
    """Writes inverted lists, a folder for each cluster, so that a search reads only those it probes."""
    coded.repartition("cluster").sortWithinPartitions("cluster", key).write.mode("overwrite").partitionBy("cluster").parquet(path)


def write_modules(rows: DataFrame, assigned: DataFrame, key: str, path: str) -> None:
    """Writes rows under a folder for each module of `assigned` (key, module); written modules can be overwritten one by one."""
    rows.join(assigned, key).repartition("module").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("module").parquet(path)


def export_json(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)
