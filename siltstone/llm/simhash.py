"""Near-duplicate documents by SimHash fingerprints, searched with vantage-point trees.

The metric is the Hamming distance of 64-bit fingerprints, the radius at most a few bits. A shard is a vantage-point tree: vantage points are its fingerprints, the others are split at the median distance, and what lies within the radius of that boundary on either side is searched against what lies there on the other (the triangle bound prunes the rest).

Shards can't be cut by distance from vantage points as well: distances between unlike texts crowd around 32 with a deviation of 4, so that every cut in two would carry half of the rows, those within 4 bits of the boundary, to both sides, and cutting 250,000 fingerprints into shards of 1000 would copy each some 400 times. So fingerprints are dealt to shards by bits instead: two that differ in `radius` bits at most agree in one of any radius + 1 blocks (or in a choice of several of more blocks), and a fingerprint goes to one shard for each. Every pair within the radius meets in at least one shard, so the result is exact.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import shingles
from siltstone.llm.common import components, fits, materialise, parts, table

LEAF = 24
#: Fingerprints in a shard, about: what one tree holds.
SHARD = 1024


def shingle_hashes(text: str | None, words: int = 4) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of a whole text. A-Z become lower case; words are runs without ASCII white space; each run of `words` words, joined by spaces, is a shingle, repeats included. Fewer words: the whole sequence is one shingle. No words: none."""
    w = (text or "").encode("utf-8", "replace").lower().split()
    n, digest = max(1, len(w) - words + 1) if w else 0, xxhash.xxh64_intdigest
    return np.array([digest(b" ".join(w[i : i + words]), 42) for i in range(n)], dtype=np.uint64)


def voted(hashes: np.ndarray) -> int:
    """The fingerprint, as an unsigned integer, for which hashes vote: 0 for none."""
    ones, n = np.zeros(64, dtype=np.int64), len(hashes)
    for at in range(0, n, 65536):
        ones += np.unpackbits(hashes[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">u8")[0])


def fingerprint(text: str | None, words: int = 4) -> int:
    """Fingerprint of a whole text, as an unsigned integer: its shingles vote."""
    return voted(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, key, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t, words) for t in b["text"]], dtype=np.uint64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "key": b["key"], "fp": fp.view(np.int64)})

    ids = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", _key(docs).alias("key")).mapInPandas(run, f"doc_id {ids}, key string, fp long")


def _key(docs: DataFrame) -> Column:
    """What tells texts apart."""
    return F.md5(F.coalesce(docs["text"], F.lit("")))


def _marks(docs: DataFrame, words: int) -> DataFrame:
    """fingerprints() with the set of a text's shingles: its hash, size and bands. A text without words has size 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            rows = []
            for t in b.column("text").to_pylist():
                every = shingle_hashes(t, words)
                own = np.unique(every)
                rows.append((np.uint64(voted(every)).view(np.int64), shingles.set_hash(own), len(own), shingles.bands(own) if len(own) else []))
            fp, sets, n, bands = zip(*rows, strict=True)
            made = [pa.array(fp, pa.int64()), pa.array(sets, pa.int64()), pa.array(n, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), *made], names=["doc_id", "key", "fp", "set", "n", "bands"])

    ids = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", _key(docs).alias("key")).mapInArrow(run, f"doc_id {ids}, key string, fp long, set long, n long, bands array<long>")


def _held(docs: DataFrame, words: int):
    """Reads the shingle sets of wanted (set, doc_id) again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            sets, hashes = [], []
            for t, s in zip(b.column("text").to_pylist(), b.column("set").to_pylist(), strict=True):
                own = np.unique(shingle_hashes(t, words))
                if shingles.set_hash(own) == s:
                    sets.append(s)
                    hashes.append(own.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(sets, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))], names=["set", "hashes"])

    return lambda wanted: docs.select("doc_id", "text").join(wanted, "doc_id").select("set", "text").mapInArrow(run, "set long, hashes array<long>")


def _shards(n: int, radius: int) -> list[list[tuple[int, int]]]:
    """The keys of n fingerprints, each a list of (shift, width): of every `radius` of the blocks the other blocks' first bits. Any choice is exact; longer keys mean smaller shards, of SHARD fingerprints about, and more blocks allow longer keys."""
    bits, count = max(0, math.ceil(math.log2(max(1, n / SHARD)))), radius + 1
    while 64 * (count - radius) // count < bits and count < radius + 4:
        count += 1
    edge = [round(64 * i / count) for i in range(count + 1)]
    out = []
    for kept in combinations(list(zip(edge, edge[1:], strict=False)), count - radius):
        share = [bits // len(kept) + (i < bits % len(kept)) for i in range(len(kept))]
        out.append([(a, min(w, z - a)) for (a, z), w in zip(kept, share, strict=True)])
    return out


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the groups of each pair i, j; labels point to the smallest index of a group."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label[:] = label[label]


def _near(x: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int, label: np.ndarray, same: bool) -> None:
    for at in range(0, len(a), 256):
        part = a[at : at + 256]
        i, j = np.nonzero(np.bitwise_count(x[part][:, None] ^ x[b][None, :]) <= radius)
        if same:
            keep = j > i + at
            i, j = i[keep], j[keep]
        if len(i):
            _merge(label, part[i], b[j])


def _join(x: np.ndarray, a: np.ndarray, radius: int, label: np.ndarray, seen: Counter | None = None) -> None:
    """Links among the points a: a vantage-point tree, built and searched at once. seen counts inner nodes, leaves, points compared in leaves, and pairs that the bound pruned."""
    seen, todo = Counter() if seen is None else seen, [(a, None)]

    def leaf(a: np.ndarray, b: np.ndarray | None) -> None:
        seen["leaves"] += 1
        seen["compared"] += len(a) * (len(a) - 1) // 2 if b is None else len(a) * len(b)
        _near(x, a, a if b is None else b, radius, label, b is None)

    while todo:
        a, b = todo.pop()
        if not len(a) or b is not None and not len(b):
            continue
        if len(a) + (0 if b is None else len(b)) <= LEAF:
            leaf(a, b)
            continue
        vantage = x[a[len(a) // 2]]
        da = np.bitwise_count(x[a] ^ vantage).astype(np.int16)
        db = None if b is None else np.bitwise_count(x[b] ^ vantage).astype(np.int16)
        every = da if b is None else np.concatenate([da, db])
        m = min(np.int16(np.median(every)), every.max() - 1)
        if m < every.min():  # all at one distance: nothing to split
            leaf(a, b)
            continue
        inner, outer = lambda d: (d <= m) & (d > m - radius), lambda d: (d > m) & (d <= m + radius)
        if b is None:
            sides = [(a[da <= m], None), (a[da > m], None), (a[inner(da)], a[outer(da)])]
            total = len(a) * (len(a) - 1) // 2
        else:
            sides = [(a[da <= m], b[db <= m]), (a[da > m], b[db > m]), (a[inner(da)], b[outer(db)]), (a[outer(da)], b[inner(db)])]
            total = len(a) * len(b)
        left = sum(len(p) * (len(p) - 1) // 2 if q is None else len(p) * len(q) for p, q in sides)
        seen["nodes"] += 1
        seen["pruned"] += total - left
        if b is not None and left * 4 > total * 3:  # the boundary holds most of both sides: comparing costs less than splitting on
            leaf(a, b)
            seen["pruned"] -= total - left
            continue
        todo += sides


def shard_links(keys: np.ndarray, x: np.ndarray, radius: int, seen: Counter | None = None) -> tuple[np.ndarray, np.ndarray]:
    """keys: sorted shard keys; x: fingerprints. Links that span each shard's groups: pairs (u, v) of fingerprints, fewer than rows."""
    label = np.arange(len(x))
    edge = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
    size = np.diff(edge)
    leaf = np.repeat(size <= LEAF, size)
    for d in range(1, LEAF):  # shards that are one leaf, all at once
        i = np.flatnonzero((keys[d:] == keys[:-d]) & leaf[:-d]) if d < len(keys) else np.empty(0, int)
        if not len(i):
            break
        i = i[np.bitwise_count(x[i] ^ x[i + d]) <= radius]
        _merge(label, i, i + d)
    for k in np.flatnonzero(size > LEAF):
        _join(x, np.arange(edge[k], edge[k + 1]), radius, label, seen)
    i = np.flatnonzero(label != np.arange(len(x)))
    return x[i], x[label[i]]


def _search(radius: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def links(b: pd.DataFrame) -> pd.DataFrame:
            u, v = shard_links(b["shard"].to_numpy(), b["fp"].to_numpy().view(np.uint64), radius)
            return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

        for b in batches:
            if not len(b):
                continue
            last = b["shard"].iloc[-1]
            if b["shard"].iloc[0] == last:
                if held and held[-1]["shard"].iloc[-1] != last:
                    yield links(pd.concat(held))
                    held = []
                held.append(b)
                continue
            cut = int(np.searchsorted(b["shard"].to_numpy(), last))
            yield links(pd.concat([*held, b.iloc[:cut]]))
            held = [b.iloc[cut:]]
        if held:
            yield links(pd.concat(held))

    return run


def links(distinct: DataFrame, radius: int = 4) -> DataFrame:
    """distinct: a written table with a column fp of distinct fingerprints. Returns links (u, v) that join whatever lies within the radius: fewer than shard members, not all pairs of a group."""
    keys = []
    for n, kept in enumerate(_shards(distinct.count(), radius)):
        key = F.lit(n).cast("long")
        for shift, width in kept:
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1).cast("long")))
        keys.append(key)
    rows = distinct.select("fp", F.explode(F.array(*keys)).alias("shard"))
    rows = rows.repartition("shard").sortWithinPartitions("shard")
    return rows.mapInPandas(_search(radius), "u long, v long").distinct()


def _grouped(docs: DataFrame, words: int, radius: int, percent: int | None) -> DataFrame:
    """(doc_id, key, fp, group, component_id) for every row of docs."""
    marks = materialise(fingerprints(docs, words) if percent is None else _marks(docs, words), "fingerprints")
    distinct = materialise(marks.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = links(distinct.select("fp"), radius)
    if percent is not None:
        found = found.unionByName(shingles.links(marks.where("n > 0 and doc_id is not null"), _held(docs, words), percent))
    linked = distinct.join(components(found), distinct["fp"] == F.col("node"))
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = linked.select("fp", "root").join(least, "root").select("fp", "root", "component_id")
    label = distinct.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("group"), F.coalesce("component_id", "least").alias("component_id"))
    return marks.select("doc_id", "key", "fp").join(label, "fp")


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, percent: int | None = None) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs.

    component_id is the smallest doc_id that can be reached over links of at most `radius` differing bits, the document's own included. Where percent is given, documents whose sets of shingles have a Jaccard similarity of percent or more are linked too, however far their fingerprints are apart. Null and empty texts have fingerprint 0 and are linked like any other. Repeated rows give repeated rows; a null doc_id stays null and is not a component_id unless its whole component has none. Texts are read whole, however long. Empty table: empty result. Columns besides doc_id and text are ignored.
    """
    return _grouped(docs, words, radius, percent).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, words: int = 5, radius: int = 4, broadcast_rows: int = 200_000, percent: int | None = 80) -> DataFrame:
    """docs without near-duplicates, by fingerprints and by the similarity of shingle sets: of each component one row stays, the one with the smallest doc_id and, where unlike texts share that id, the smallest hash of its text. Rows that share an id are judged each by its own text.

    Of rows with equal id and text one stays (that with the least hash of all its columns). Null and empty texts are near-duplicates of one another. Rows with a null doc_id take no part and stay. Texts are read whole. Empty table: empty result. Other columns are kept as they are, whatever their names.
    """
    named = docs.where("doc_id is not null")
    found = materialise(_grouped(named, words, radius, percent).select("doc_id", "key", "group"), "grouped")
    first = found.groupBy("group").agg(F.min(F.struct("doc_id", "key")).alias("first"))
    other = (F.col("doc_id") != F.col("first.doc_id")) | (F.col("key") != F.col("first.key"))
    gone = materialise(found.join(first, "group").where(other).select(F.col("doc_id").alias("_gone"), F.col("key").alias("_gone_key")).distinct(), "gone")
    repeated = materialise(found.groupBy("doc_id", "key").count().where("count > 1").select(F.col("doc_id").alias("_again"), F.col("key").alias("_again_key")), "repeated")
    rows = named.select(F.col("doc_id").alias("_id"), _key(named).alias("_key"), F.struct(*(named[c] for c in docs.columns)).alias("_row"))
    if not repeated.isEmpty():
        again = (F.col("_id") == F.col("_again")) & (F.col("_key") == F.col("_again_key"))
        order = F.xxhash64(*(F.col("_row")[f.name] for f in docs.schema.fields if "map<" not in f.dataType.simpleString()))
        single = rows.join(repeated, again, "left_semi").groupBy("_id", "_key").agg(F.min_by("_row", order).alias("_row"))
        rows = rows.join(repeated, again, "left_anti").unionByName(single)
    small = F.broadcast(gone) if fits(gone, broadcast_rows) else gone
    rows = rows.join(small, (F.col("_id") == F.col("_gone")) & (F.col("_key") == F.col("_gone_key")), "left_anti")
    return rows.select(*(F.col("_row")[c].alias(c) for c in docs.columns)).unionByName(docs.where("doc_id is null"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
