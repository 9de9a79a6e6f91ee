"""Resampling, embedding near-duplicates and the audit of sources: against brute force, SQL, and rows with nulls, ties, repeats and odd texts."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import brute_places, odd

from siltstone.llm import decontam, divergence, importance, licences, multiindex
from siltstone.llm.common import table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- 11

def brute_resampling(docs, target, longest=1, buckets=10000, least=20, percent=10):
    def runs(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        return len(w), [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(bucket(f) for _, x in docs for f in runs(x)[1]), Counter(bucket(f) for x in target for f in runs(x)[1])
    gain = {b: math.floor(1000 * math.log(((t[b] + 1) * (s.total() + buckets)) / ((s[b] + 1) * (t.total() + buckets)))) for b in s}
    out, able = [], []
    for n, (i, x) in enumerate(docs):
        words, own = runs(x)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in own)
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if words >= least:
            able.append(n)
    able.sort(key=lambda n: (-out[n][3], out[n][0] is None, out[n][0] or 0))
    for place, n in enumerate(able[: percent * len(able) // 100], 1):
        out[n][4] = place
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("longest", [1, 2])
def test_resampling(spark, sf_dir, longest):
    docs = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    target = [r["text"] for r in table(spark, sf_dir, "benchmark").collect()]
    got = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), longest)
    assert sorted(map(tuple, got.collect()), key=str) == brute_resampling(docs, target, longest)


def test_resampling_odd_rows(spark):
    docs = odd(spark)
    extra = spark.createDataFrame([(None, "Äpfel ÄPFEL " * 30), (9, "the same " * 40), (9, "the same " * 40), (10, "It's 4-fold"), (11, "x" * 300_000 + " y" * 100_000)], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(extra)
    target = spark.createDataFrame([("the same", 1), (None, 2), ("", 3), ("Äpfel four", 4)], "text string, item_id long")
    given = [tuple(r) for r in every.collect()]
    for least, percent in ((1, 60), (20, 10), (0, 100)):
        got = sorted(map(tuple, importance.resample(every, target, least=least, percent=percent).collect()), key=str)
        assert [r[:4] for r in got] == [r[:4] for r in brute_resampling(given, [r["text"] for r in target.collect()], least=least, percent=percent)]
        ranks = sorted(r[4] for r in got if r[4])
        want = brute_resampling(given, [r["text"] for r in target.collect()], least=least, percent=percent)
        assert ranks == sorted(r[4] for r in want if r[4]) and sorted(r[3] for r in got if r[4]) == sorted(r[3] for r in want if r[4])
    assert importance.resample(docs.limit(0), target).count() == 0
    assert importance.resample(docs, target.limit(0)).count() == docs.count()
    assert importance.resample(docs.withColumn("block", docs.n_chars).withColumn("rank", docs.lang), target).columns == ["doc_id", "n_features", "weight", "score", "rank"]


def test_blocks_bound_memory(spark, sf_dir):
    """Blocks are cut by size and the result doesn't follow the cut."""
    docs = table(spark, sf_dir, "documents")
    many = importance.blocks(docs, 1, size=1000)
    assert many.count() > 100 and many.select("ids").collect()
    words = lambda df: sorted(map(tuple, importance.dictionary(df, 10000).collect()))
    assert words(many) == words(importance.blocks(docs, 1))


# ---- 12

def planted(seed=3, dim=24, n=700, group=150):
    """Random vectors, a group of near copies, a chain, equal and scaled vectors."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    core = rng.standard_normal(dim)
    near = core + rng.standard_normal((group, dim)) * 0.12
    far = core + rng.standard_normal((group // 3, dim)) * 0.38
    chain, out = rng.standard_normal(dim), []
    for _ in range(25):
        chain = chain + rng.standard_normal(dim) * 0.25
        out.append(chain)
    x = np.concatenate([x, near, far, out, np.repeat(x[:1], 60, axis=0), 3 * x[1:3], x[5:6] + 0.05])
    rng.shuffle(x)
    return [(i * 3, [float(np.float32(v)) for v in row]) for i, row in enumerate(x)]


def brute_links(data, least=0.9):
    ids = [i for i, _ in data]
    x = np.array([v for _, v in data])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= least
    np.fill_diagonal(linked, False)
    root = np.array(ids)
    while True:
        new = np.array([min(root[i], root[linked[i]].min(initial=root[i])) for i in range(len(ids))])
        if (new == root).all():
            return {i: (int(linked[n].sum()), int(root[n])) for n, i in enumerate(ids)}
        root = new


@pytest.mark.parametrize("block", [4096, 64, 20])
def test_embedding_links(spark, block):
    """Small blocks split cells over shards, make balls of the large ones and slices of visitors."""
    data = planted()
    want = brute_links(data)
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(5)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in multiindex.near_duplicates(df, block=block).collect()}
    assert set(got) == set(want)
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in got.values()) >= 0.99 * sum(n for n, _ in want.values())
    assert sum(got[i] == want[i] for i in want) >= 0.97 * len(want)


def test_balls_are_counted_not_compared(spark):
    """A third of all vectors near one another: links come from the ball, with the exact counts."""
    rng = np.random.default_rng(5)
    core = rng.standard_normal(16)
    x = np.concatenate([rng.standard_normal((400, 16)), core + rng.standard_normal((500, 16)) * 0.05])
    data = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in multiindex.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>"), block=30).collect()}
    want = brute_links(data)
    assert sum(got[i] == want[i] for i in want) >= 0.99 * len(want)
    assert all(got[i] == want[i] for i in range(400, 900))


def test_walk_is_the_multi_sequence_order():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 10))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    books = multiindex.fit(x, 300, 0.9, 0.99)
    one, two = books.beyond(x[:20])
    for i, seen in enumerate(books.walk(x[:20])):
        every = (one[i][:, None] + two[i][None, :]).ravel()
        assert sorted(seen) == list(np.flatnonzero(every <= books.reach)) and books.cells(x[i : i + 1])[0] in seen


def test_embedding_recall(spark, sf_dir):
    """Against brute force on all vectors of sf0.1 with a near copy of every tenth planted."""
    e = table(spark, sf_dir.replace("sf0.001", "sf0.1"), "embeddings").select("vec_id", "embedding").collect()
    rng = np.random.default_rng(2)
    data = [(r["vec_id"], list(r["embedding"])) for r in e]
    for i, v in data[::10]:
        turn = rng.standard_normal(len(v))
        turn -= turn @ np.array(v) * np.array(v)
        c = rng.uniform(0.9, 1)
        data.append((1_000_000 + i, (c * np.array(v) + math.sqrt(1 - c * c) * turn / np.linalg.norm(turn)).tolist()))
    want = brute_links(data)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in multiindex.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>"), block=256).collect()}
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in got.values()) >= 0.99 * sum(n for n, _ in want.values()) > 0


def test_embedding_odd_rows(spark):
    v = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, [0.0, 2.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [float("inf"), 1.0]), (None, [1.0, 0.0]), (9, [1.0, 0.0, 0.0]), (3, [0.0, 2.0]), (10, []), (11, [1e-200, 1e-202]), (12, [-1.0, 0.0]), (13, [5.0]), (14, [0.5])]
    df = spark.createDataFrame([(i, x, 1, 2, "c") for i, x in v], "vec_id long, embedding array<double>, node long, m long, links string")
    got = sorted((tuple(r) for r in multiindex.near_duplicates(df).collect()), key=str)
    want = [(0, 3, 0, True), (1, 3, 0, False), (2, 3, 0, False), (3, 1, 3, True), (3, 1, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True), (10, 0, 10, True), (11, 3, 0, False), (12, 0, 12, True), (13, 1, 13, True), (14, 1, 13, False), (None, 0, None, True)]
    assert got == sorted(want, key=str)
    assert multiindex.near_duplicates(df.limit(0)).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(300)], "vec_id long, embedding array<double>")
    assert {tuple(r)[1:] for r in multiindex.near_duplicates(same, block=16).collect()} == {(299, 0, True), (299, 0, False)}


# ---- 13

def by_sql(spark, docs):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", docs)
    return sorted(con.sql(f"SELECT lang, source, part, item, value, rank FROM ({divergence.ORACLE_SQL})").fetchall())


def test_audit_of_odd_rows(spark):
    """Null and empty lang, source and text; a language without kept terms; one with one source; ties; repeats; a very long text; one source with most rows."""
    rng = np.random.default_rng(4)
    words = ["alpha", "Beta", "gamma", "délta", "épsilon", "x1y", "zêta"]
    docs = [(n, " ".join(rng.choice(words, 12)), ["en", None, "de"][n % 3], "hot" if n % 5 else [None, "", "s1", "s2"][n // 5 % 4]) for n in range(400)]
    docs += [(1, "alpha " * 5, "en", "s3")] * 3 + [(2, None, "en", "silent"), (3, "", "xx", "a"), (4, "rare words", "xx", "b"), (None, "gamma", "one", "only"), (5, "long alpha " * 20_000, "en", "s2")]
    docs += [(n, "solo common", "one", "only") for n in range(40)]
    df = spark.createDataFrame([(*d, 1, "t") for d in docs], "doc_id long, text string, lang string, source string, count long, term string")
    got = sorted(map(tuple, divergence.audit(df.repartition(7)).collect()))
    assert got == by_sql(spark, docs)
    assert ("xx", "a", "pair", "b", 0, 1) in got and ("en", "silent", "pair", "hot") in {r[:4] for r in got}
    assert divergence.audit(df.limit(0)).count() == 0


def test_counts_are_bounded(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    assert sorted(map(tuple, divergence.counted(docs, most=500).collect())) == sorted(map(tuple, divergence.counted(docs).collect()))


def test_shares_are_exact(spark):
    big = spark.range(1).select(divergence.share(*(F.lit(n).cast("long") for n in (10**13, 10**14, 10**6))).alias("p"))
    assert big.first()["p"] == 1 + 10**9 * (10**13 + 5) // (10**14 + 5 * 10**6)


# ---- 7, repeats and letters that grow in lower case

def test_many_inexact_copies():
    rng = np.random.default_rng(6)
    item = " ".join("".join(chr(97 + c) for c in rng.integers(0, 8, 6)) for _ in range(9))

    def edited():
        t = list(item)
        for _ in range(int(rng.integers(0, 5))):
            at = int(rng.integers(0, len(t)))
            t[at : at + 1] = [[], ["z"], [t[at], "q"]][int(rng.integers(0, 3))]
        return "".join(t)

    text = decontam.normal(" ".join(edited() + " " * int(rng.integers(0, 2)) + "uv wx" * int(rng.integers(0, 2)) for _ in range(50)) + " end" * 3000)
    ix = decontam.index([(1, item)], 0.1)
    got = sorted((x, y, e) for _, _, x, y, e in decontam.occurrences([text], ix))
    assert got == sorted((x, y, e) for e, x, y in brute_places(item, text, int(ix.k[0]))) and len(got) >= 40


def test_spans_beside_letters_that_grow(spark):
    item = "a benchmark passage that is long enough to be found"
    texts = [f"İstanbulİ kill {item} İ", f"{item.upper()} İİ", f"İ {item}", f"ΣΑΣ {item} ΣΑΣ ﬁ", f"{item} İ {item}"]
    docs = spark.createDataFrame([(n, t, "x", 1) for n, t in enumerate(texts)] * 2, "doc_id long, text string, item_id string, start int")
    found = decontam.contamination(docs, spark.createDataFrame([(1, item, 5)], "item_id long, text string, end int")).collect()
    assert len(found) == 2 * 6 and all(texts[r["doc_id"]][r["start"] : r["end"]].lower() == item for r in found)


# ---- 10, denied, joined and foreign

@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("This code is not licensed under the Apache License, Version 2.0.", []), ("This code isn't licensed under the MIT License.", []), ("It is no longer available under the MIT license.", []), ("This code is licensed under the Apache License, Version 2.0, not the MIT License.", ["Apache-2.0"]),
        ("SPDX-License-Identifier: MIT OR Apache-2.0", ["MIT", "Apache-2.0"]), ("// SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0) AND (BSD-3-Clause or MIT)\nint x;", ["GPL-2.0-only WITH Classpath-exception-2.0", "BSD-3-Clause", "MIT"]),
        ("Distributed under the Mozilla Public License, v. 2.0.", ["MPL-2.0"]), ("Dieser Text steht unter der Lizenz CC-BY-SA 4.0.", ["CC-BY-SA"]), ("CC BY 4.0", ["CC-BY"]), ("SPDX-License-Identifier:", []), ("Neither the name of X may be used to endorse or promote it.", []),
    ],
)
def test_licences_said_otherwise(text, want):
    assert licences.recognise(text)[0] == want
