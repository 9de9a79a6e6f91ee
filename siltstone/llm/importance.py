"""Importance resampling towards a target: documents are drawn by how much more their features belong to the target than to the corpus.

Features are runs of words, hashed into buckets. Texts are read once, in blocks of some megabytes; a block lists each of its distinct features once, with how often it occurs, and each document as positions in that list. Blocks' lists meet in one dictionary of distinct features, where each string is hashed once; buckets add up from it; and gains go back to the blocks' lists, never to single words. A word that every document has costs one row for each block.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import discard, materialise, parts, table
from siltstone.operators.running import numbered

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
BLOCKS = "block long, words array<binary>, totals array<long>, ids array<long>, sizes array<long>, kinds array<int>, at array<int>, times array<int>"


def features(text: bytes, longest: int) -> tuple[int, Counter]:
    """Words of a text, and how often it has each run of 1 to `longest` of them."""
    words = WORD.findall(text.lower())  # of bytes, so A-Z only
    found = Counter(words)
    for n in range(2, longest + 1):
        found.update(b" ".join(words[i : i + n]) for i in range(len(words) - n + 1))
    return len(words), found


def blocks(docs: DataFrame, longest: int, size: int = 4_000_000) -> DataFrame:
    """One row for each block of texts of `size` bytes together (one text at least): its distinct features (words) with totals, and its documents in order: ids, sizes in words, how many distinct features each has (kinds), their positions in `words` (at) and how often each occurs (times)."""

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, task, schema = 0, TaskContext.get().partitionId(), None

        def done() -> pa.RecordBatch:
            totals = np.zeros(len(known), dtype=np.int64)
            at_, times_ = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (at, times))
            np.add.at(totals, at_, times_)
            lists = [list(known), totals, ids, sizes, kinds, at_.astype(np.int32), times_.astype(np.int32)]
            types = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            whole = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, t)) for x, t in zip(lists, types, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([task << 32 | number], pa.int64()), *whole], ["block", "words", "totals", "ids", "sizes", "kinds", "at", "times"])

        known, ids, sizes, kinds, at, times, held = {}, [], [], [], [], [], 0
        for b in parts(batches, 200):
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                n, found = features(text or b"", longest)
                ids.append(doc)
                sizes.append(n)
                kinds.append(len(found))
                at.append(np.fromiter((known.setdefault(f, len(known)) for f in found), dtype=np.int64, count=len(found)))
                times.append(np.fromiter(found.values(), dtype=np.int64, count=len(found)))
                held += len(text or b"") + 100
                if held >= size:
                    yield done()
                    known, ids, sizes, kinds, at, times, held, number = {}, [], [], [], [], [], 0, number + 1
        if ids:
            yield done()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(block, BLOCKS)


def dictionary(of: DataFrame, buckets: int) -> DataFrame:
    """(word, count, bucket) of each distinct feature of blocks."""
    listed = of.select(F.explode(F.arrays_zip("words", "totals")).alias("w")).select("w.words", "w.totals")
    return listed.groupBy(F.col("words").alias("word")).agg(F.sum("totals").alias("count")).withColumn("bucket", (F.crc32("word") % buckets).cast("int"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of the buckets of two dictionaries: at most `buckets` rows."""
    s = corpus.groupBy("bucket").agg(F.sum("count").alias("s"))
    t = target.groupBy(F.col("bucket").alias("_bucket")).agg(F.sum("count").alias("t"))
    both = s.join(t, F.col("bucket") == F.col("_bucket"), "left").select("bucket", "s", F.coalesce("t", F.lit(0)).alias("t"))
    sums = [x.agg(F.coalesce(F.sum("count"), F.lit(0)).alias(n)) for x, n in ((corpus, "all_s"), (target, "all_t"))]
    d = lambda c, more: (F.col(c) + more).cast("double")
    ratio = (d("t", 1) * d("all_s", buckets)) / (d("s", 1) * d("all_t", buckets))
    return both.join(F.broadcast(sums[0])).join(F.broadcast(sums[1])).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10000, least: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs (doc_id, text), rank being its place among those drawn, null for the others.

    Drawn without replacement: of the N documents of `least` words or more, floor(percent * N / 100) with the highest scores (weight and Gumbel noise of the id), ties to the smaller doc_id, null ids last. Null and empty texts have no features and weight 0. A null id has noise like the empty id. Repeated rows are documents of their own. An empty target has gains all the same; no documents give no rows. Other columns are ignored.
    """
    of = materialise(blocks(docs, longest), "blocks", most=8)
    corpus = materialise(dictionary(of, buckets), "dictionary")
    goal = materialise(dictionary(blocks(target.select(F.lit(None).alias("doc_id"), "text"), longest), buckets), "target")
    gain = materialise(gains(corpus, goal, buckets), "gains")
    known = corpus.join(F.broadcast(gain), "bucket").select("word", "gain")
    listed = of.select("block", F.posexplode("words").alias("place", "word")).join(known, "word")
    packed = F.col("place") * F.lit(1 << 32) + F.col("gain") + F.lit(1 << 31)  # one long for each, in order of place
    back = listed.groupBy(F.col("block").alias("_block")).agg(F.sort_array(F.collect_list(packed)).alias("gains"))
    whole = of.select("block", "ids", "sizes", "kinds", "at", "times").join(back, F.col("block") == F.col("_block"), "left").drop("block", "_block")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, 1):
            ids, sizes, kinds, at, times, gain = (b.column(c).flatten() for c in ("ids", "sizes", "kinds", "at", "times", "gains"))
            times, ends = times.to_numpy().astype(np.int64), np.cumsum(kinds.to_numpy())
            gain = (gain.to_numpy() & 0xFFFFFFFF) - (1 << 31)
            sums = np.concatenate([[0], np.cumsum(gain[at.to_numpy()] * times)]) if len(at) else np.zeros(1, dtype=np.int64)
            counts = np.concatenate([[0], np.cumsum(times)])
            starts = np.concatenate([[0], ends[:-1]])
            yield pa.RecordBatch.from_arrays([ids, sizes, pa.array(counts[ends] - counts[starts]), pa.array((sums[ends] - sums[starts]).astype(np.int64))], ["doc_id", "n_words", "n_features", "weight"])

    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    scored = whole.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long").withColumn("score", F.col("weight") + noise)
    scored = materialise(scored, "scores")
    discard(of, corpus, goal, gain)
    able = scored.agg(F.count_if(F.col("n_words") >= least)).first()[0]
    first = [F.desc("score"), F.asc_nulls_last("doc_id")]
    placed = numbered(scored.where(F.col("n_words") >= least), first, "rank").withColumn("rank", F.when(F.col("rank") <= percent * able // 100, F.col("rank")))
    rest = scored.where(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long"))
    return placed.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH crc AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS steps FROM range(256) t(i)),
words AS (SELECT 0 AS target, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS r FROM documents
 UNION ALL SELECT 1, NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), row_number() OVER () FROM benchmark),
runs AS (SELECT target, r, unnest(w) AS word FROM words),
known AS (SELECT word, count(*) FILTER (WHERE target = 0) AS s, count(*) FILTER (WHERE target = 1) AS t, hex(encode(word)) AS x FROM runs GROUP BY word),
hashed AS (SELECT word, s, t, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(x), 2), lambda i: ('0x' || substr(x, i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, steps[xor(c & 255, b) + 1]))) % 10000 AS bucket FROM known, crc),
sums AS (SELECT bucket, sum(s) AS s, sum(t) AS t FROM hashed GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * ((SELECT sum(s) FROM sums) + 10000)::DOUBLE) / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM sums) + 10000)::DOUBLE)))::BIGINT AS gain FROM sums),
weights AS (SELECT r, sum(gain)::BIGINT AS weight FROM runs JOIN hashed USING (word) JOIN gains USING (bucket) WHERE target = 0 GROUP BY r),
scored AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM words LEFT JOIN weights USING (r) WHERE target = 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place, (SELECT count(*) * 10 // 100 FROM scored WHERE n_features >= 20) AS most FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= most THEN place END AS rank FROM placed
"""
