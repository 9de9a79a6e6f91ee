"""Indexes that lie in the shared folder, for as long as their table stays as it is."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import SparkSession

from siltstone.operators import inverted, search
from siltstone.sources.tables import shared_folder, table


#: Indexes opened by this process, by application and folder.
_OPEN: dict[tuple[str, str], inverted.Index] = {}
#: Changes with the form of what is stored.
FORM = 2


def text_index(spark: SparkSession, sf_dir: str) -> inverted.Index:
    """The index of documents by title and text. The first application that needs it writes it under a name of its own and then moves it to where others look, so it is there whole or not at all; the place's name follows the table's files, their sizes and times, so a changed table is indexed anew."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    held = source.getFileSystem(conf).listStatus(source)
    state = "|".join(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in held)
    path = f"{shared_folder(spark)}/siltstone-index-{FORM}-{hashlib.sha256(state.encode()).hexdigest()[:24]}"
    opened = (spark.sparkContext.applicationId, path)
    if opened in _OPEN:
        return _OPEN[opened]
    there = jvm.org.apache.hadoop.fs.Path(path)
    fs = there.getFileSystem(conf)
    if not fs.exists(there):
        own = f"{path}-{uuid.uuid4().hex}"
        inverted.write(search.passages(table(spark, sf_dir, "documents")), own, fields=("title", "text"))
        mine = jvm.org.apache.hadoop.fs.Path(own)
        if fs.exists(there) or not fs.rename(mine, there):  # another application was first
            fs.delete(mine, True)
    _OPEN[opened] = inverted.Index(spark, path)
    return _OPEN[opened]
