"""Documents alike by their shingle sets.

A document is the set of its shingles' hashes. Sets are listed under BANDS hashes of ROWS minima each; two sets of Jaccard similarity s meet with a probability of 1 - (1 - s^ROWS)^BANDS, that is all but 1.4e-7 of the pairs at 0.8 and fewer still are missed above. Whatever meets is verified on the sets, so no pair below the threshold is linked. In a first round sets meet the first one of their band only, in a second those that are still in different groups meet each other: a large group of near copies never becomes all its pairs.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import components, fits, materialise

BANDS, ROWS = 30, 4
FACTORS = np.random.default_rng(11).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bands(hashes: np.ndarray) -> np.ndarray:
    """The keys, as signed longs, under which a non-empty set of hashes is listed."""
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[at : at + 1024, None] * FACTORS).min(axis=0), out=least)
    return np.array([xxhash.xxh64_intdigest(part.tobytes(), i) for i, part in enumerate(least.reshape(BANDS, ROWS))], dtype=np.uint64).view(np.int64)


def set_hash(hashes: np.ndarray) -> int:
    """One signed long for a sorted set of hashes."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes())).view(np.int64))


def _verified(pairs: DataFrame, sets: DataFrame, held, percent: int, broadcast_rows: int) -> DataFrame:
    """(u, v) of those pairs of sets whose similarity is percent or more."""
    ids = pairs.select(F.col("u").alias("_set")).unionByName(pairs.select(F.col("v").alias("_set"))).distinct()
    wanted = materialise(sets.join(ids, F.col("set") == F.col("_set"), "left_semi").select("set", F.col("p.doc_id").alias("doc_id")), "wanted")
    whole = materialise(held(F.broadcast(wanted) if fits(wanted, broadcast_rows) else wanted).dropDuplicates(["set"]), "sets")
    x, y = (whole.select(F.col("set").alias(c), F.col("hashes").alias(f"_{c}")) for c in "uv")
    shared = F.size(F.array_intersect("_u", "_v"))
    both = pairs.join(x, "u").join(y, "v")
    return both.where(shared * 100 >= (F.size("_u") + F.size("_v") - shared) * percent).select("u", "v")


def links(marks: DataFrame, held, percent: int = 80, broadcast_rows: int = 200_000) -> DataFrame:
    """Links (u, v) of fingerprints that join all documents of a similarity of `percent` or more.

    marks: a written table (doc_id, fp, set, n, bands) of the documents with words. held gives (set, hashes) for a table (set, doc_id).
    """
    sets = materialise(marks.groupBy("set").agg(F.min(F.struct("doc_id", "fp")).alias("p"), F.first("n").alias("n"), F.first("bands").alias("bands")), "sets")
    place = sets.select(F.col("set").alias("_set"), F.col("p.fp").alias("_fp"))
    same = marks.select("set", "fp").distinct().join(place, F.col("set") == F.col("_set")).where("fp != _fp").select(F.col("fp").alias("u"), F.col("_fp").alias("v"))
    posted = sets.select("set", "n", F.explode("bands").alias("band"))
    near = lambda a, b: (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)
    leads = posted.groupBy("band").agg(F.min(F.struct("set", "n")).alias("lead"), F.count("*").alias("m")).where("m > 1").select(F.col("band").alias("_band"), F.col("lead.set").alias("u"), F.col("lead.n").alias("_n"))
    first = posted.join(leads, F.col("band") == F.col("_band")).where((F.col("set") != F.col("u")) & near("n", "_n"))
    first = materialise(first.select("u", F.col("set").alias("v")).distinct(), "pairs")
    linked = materialise(_verified(first, sets, held, percent, broadcast_rows), "linked")
    grouped = posted.join(components(linked), F.col("set") == F.col("node"), "left").select("set", "n", "band", F.coalesce("root", "set").alias("group"))
    mixed = grouped.groupBy("band").agg(F.min("group").alias("_a"), F.max("group").alias("_z")).where("_a != _z").select("band")
    rest = materialise(grouped.join(mixed, "band", "left_semi"), "mixed")
    a, b = (rest.select(F.col("band").alias(f"{c}_band"), F.col("set").alias(c), F.col("n").alias(f"{c}_n"), F.col("group").alias(f"{c}_group")) for c in "uv")
    second = a.join(b, (F.col("u_band") == F.col("v_band")) & (F.col("u") < F.col("v")) & (F.col("u_group") != F.col("v_group")) & near("u_n", "v_n"))
    second = materialise(second.select("u", "v").distinct().join(first, ["u", "v"], "left_anti"), "pairs")
    linked = linked.unionByName(_verified(second, sets, held, percent, broadcast_rows))
    u, v = (place.select(F.col("_set").alias(c), F.col("_fp").alias(f"{c}_fp")) for c in "uv")
    return linked.join(u, "u").join(v, "v").select(F.col("u_fp").alias("u"), F.col("v_fp").alias("v")).unionByName(same)
