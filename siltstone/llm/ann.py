"""Approximate nearest neighbours by cosine: a hash-prefix forest.

Rows are dealt to shards, each with a forest over its vectors. A tree's hash string is a row of digits; a digit names the axis, with its sign, nearest to the vector after a random rotation of the tree and level (a cross-polytope hash, which for near-orthogonal vectors tells neighbours apart far better than single hyperplane bits). Each tree is a sorted array of such strings. A query descends in every tree to its longest matching prefixes and all trees ascend together, one digit at a time: at each level the candidates are the vectors that share that prefix in `agree` trees or more, and the ascent ends at the first level with `enough` of them, at the root at last. Candidates are ranked by their exact cosine in double precision. Every row is indexed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.llm.common import materialise, table


@lru_cache(maxsize=4)
def _rotations(dim: int, trees: int, digits: int) -> np.ndarray:
    """trees x digits Gaussian matrices, the same wherever they are made."""
    return np.random.default_rng([dim, trees, digits]).standard_normal((trees, digits, dim, dim)).astype(np.float32)


def strings(x: np.ndarray, trees: int, digits: int) -> np.ndarray:
    """Hash strings, one row for each tree, packed into a long: the first digit is the highest."""
    dim = x.shape[1]
    out, unit = np.zeros((trees, len(x)), dtype=np.int64), x.astype(np.float32)
    for t, tree in enumerate(_rotations(dim, trees, digits)):
        y = (unit @ tree.transpose(1, 0, 2).reshape(dim, digits * dim)).reshape(len(x), digits, dim)
        high, low = y.argmax(axis=2), y.argmin(axis=2)
        up, down = np.take_along_axis(y, high[..., None], 2)[..., 0], np.take_along_axis(y, low[..., None], 2)[..., 0]
        digit = np.where(up >= -down, 2 * high + 1, 2 * low)
        for level in range(digits):
            out[t] = out[t] * (2 * dim) + digit[:, level]
    return out


def unit(rows: list) -> np.ndarray:
    x = np.array([np.asarray(r, dtype=np.float64) for r in rows])
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Forest:
    def __init__(self, x: np.ndarray, trees: int, digits: int):
        self.x, self.trees, self.digits, self.radix = x, trees, digits, 2 * x.shape[1]
        codes = strings(x, trees, digits)
        self.order = np.argsort(codes, axis=1, kind="stable")
        self.sorted = np.take_along_axis(codes, self.order, axis=1)

    def candidates(self, codes: np.ndarray, agree: int, enough: int) -> Iterator[np.ndarray]:
        """Candidates of each query in turn, given the queries' hash strings in each tree (trees x queries)."""
        levels = range(self.digits, 0, -1)
        bounds = {}
        for level in levels:
            rest = self.radix ** (self.digits - level)
            low = codes // rest * rest
            bounds[level] = [[np.searchsorted(self.sorted[t], low[t] + add).tolist() for t in range(self.trees)] for add in (0, rest)]
        for i in range(codes.shape[1]):
            for level in levels:
                first, last = bounds[level]
                parts = [self.order[t, first[t][i] : last[t][i]] for t in range(self.trees) if first[t][i] < last[t][i]]
                if sum(map(len, parts)) < agree * enough:
                    continue
                found = np.flatnonzero(np.bincount(np.concatenate(parts), minlength=len(self.x)) >= agree)
                if len(found) >= enough:
                    break
            else:
                found = np.arange(len(self.x))
            yield found


def _digits(dim: int) -> int:
    """Digits of a string: up to 3, as fit a long; more don't tell vectors apart further where a shard has some thousands."""
    return max(1, min(3, int(62 // math.log2(max(2, 2 * dim)))))


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select("vec_id", "embedding").where("vec_id is not null").where(v.isNotNull() & finite & F.exists(v, lambda x: x != 0))


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, trees: int = 128, agree: int = 3, enough: int = 32, query_block: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by `every`, the k nearest rows found among all others.

    Rows with a null id or vector, a zero vector, or null or non-finite components take no part; vectors of other lengths are no candidates. Ties go to the smaller vec_id; rows that repeat an id with its vector count once. Fewer than k other rows: all of them. Equal vectors are indexed once with their k + 1 least ids, which is all that any result can hold of them, so a vector that makes up much of the table costs no more than another. Queries are a stated share of the rows and go to every shard in blocks. Empty table: empty result; other columns are ignored.
    """
    rows = valid(vectors)
    first = W.partitionBy("embedding").orderBy("vec_id")
    ranked = rows.withColumn("_n", F.dense_rank().over(first)).where(F.col("_n") <= k + 1)
    distinct = materialise(ranked.groupBy("embedding").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")), "vectors")
    n = distinct.count()
    shards = max(1, n // max(2048, min(65536, n // 64)))
    dim = F.size("embedding")
    asked = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "embedding").distinct()
    asked = asked.withColumn("_q", F.md5(F.concat_ws(",", F.col("embedding").cast("array<string>"))))
    asked = materialise(asked, "queries")
    blocks = max(1, math.ceil(asked.count() / query_block))
    block = F.pmod(F.xxhash64("_q"), F.lit(blocks)).cast("int")
    left = distinct.withColumn("_shard", F.pmod(F.xxhash64("ids"), F.lit(shards)).cast("int")).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, part in b.groupby(b["embedding"].map(len)):
                x = unit(part["embedding"])
                yield part.assign(_codes=list(strings(x, trees, _digits(x.shape[1])).T))

    once = asked.groupBy("_q").agg(F.first("embedding").alias("embedding"))
    kind = vectors.schema["embedding"].dataType.simpleString()
    once = materialise(once.mapInPandas(hashed, f"_q string, embedding {kind}, _codes array<bigint>"), "hashed")
    right = once.withColumn("_block", block).withColumn("_shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def search(own: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(queries):
            x, q = unit(own["embedding"]), unit(queries["embedding"])
            forest = Forest(x, trees, _digits(x.shape[1]))
            codes = np.array(queries["_codes"].tolist(), dtype=np.int64).T
            ids = own["ids"].tolist()
            least = np.array([i[0] for i in ids])
            raw, asked_ = own["embedding"].tolist(), queries["embedding"].tolist()
            for i, (key, found) in enumerate(zip(queries["_q"], forest.candidates(codes, agree, enough), strict=True)):
                score = x[found] @ q[i]
                if len(found) > 4 * k + 4:
                    near = np.argpartition(-score, k + 1)[: k + 2]
                    found = found[score >= score[near].min() - 1e-9]
                exact = [(-cosine(raw[j], asked_[i]), int(least[j]), j) for j in found]
                best = sorted((s, int(v)) for s, _, j in sorted(exact)[: k + 1] for v in ids[j])[: k + 1]
                out += [(key, v, -s) for s, v in best]
        return pd.DataFrame(out, columns=["_q", "vec_id", "score"])

    left, right = left.withColumn("_dim", dim), right.withColumn("_dim", dim)
    keys = ["_dim", "_shard", "_block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, f"_q string, vec_id {_kind(vectors)}, score double")
    best = W.partitionBy("_q").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k + 1).select("_q", "vec_id", "score")
    own = asked.select("query_id", F.col("_q").alias("_k"))
    pairs = own.join(found, F.col("_k") == F.col("_q")).where("query_id != vec_id")
    rank = F.row_number().over(W.partitionBy("query_id", "_q").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def cosine(a, b) -> float:
    a, b = np.asarray(a, dtype=np.float64), np.asarray(b, dtype=np.float64)
    m, n = np.abs(a).max(), np.abs(b).max()
    if not (1e-100 < m < 1e100 and 1e-100 < n < 1e100):
        a, b = a / m, b / n
    return float(np.dot(a, b) / (math.sqrt(np.dot(a, a)) * math.sqrt(np.dot(b, b))))


def _kind(vectors: DataFrame) -> str:
    return vectors.schema["vec_id"].dataType.simpleString()


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
