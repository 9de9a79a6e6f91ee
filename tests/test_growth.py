"""What queries do on crowded tables: rows that meet, and what reaches a task, must not grow with the square of a group."""

from __future__ import annotations

import json
import zlib

import pyarrow as pa
from pyspark.sql import functions as F

from siltstone.functions import hashing, steps
from siltstone.functions.text import query_terms, tokens
from siltstone.llm import lines, pii
from siltstone.llm.common import fits, materialise
from siltstone.operators import chunking, coverage, inverted, places, vectors
from siltstone.plans import answers, collections, evidence, travel, wordings
from siltstone.sources import blocks


def most_rows(df, name: str = "numOutputRows") -> int:
    """The most rows that one step of df's plan gives, df being run; name: of the metric that counts them."""
    df.collect()
    most, open_ = 0, [df._jdf.queryExecution().executedPlan()]
    while open_:
        plan = open_.pop()
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            open_.append(plan.executedPlan())
        elif kind.endswith("QueryStageExec"):
            open_.append(plan.plan())
        held = plan.metrics().get(name)
        most = max(most, held.get().value() if held.isDefined() else 0)
        children = plan.children()
        open_ += [children.apply(i) for i in range(children.size())]
    return most


def test_settlements_of_one_spot_meet_once(spark):
    """300 places and 400 towns of one spot: 120,000 pairs, of which one for each spot can be an answer; ties, null names and repeated keys as before."""
    spots = spark.range(300).select((F.col("id") % 299).alias("id"), F.lit(10.25).alias("lat"), F.when(F.col("id") < 299, 20.5).otherwise(40.5).alias("lon"))
    towns = spark.range(400).select(F.concat(F.lit("t"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("town"), F.lit(10.35).alias("lat"), F.lit(20.5).alias("lon"), F.when(F.col("id") >= 7, F.lit(150_000)).otherwise(5).cast("long").alias("population"))
    small = spark.createDataFrame([("b", 10.26, 40.5, 3), ("a", 10.26, 40.5, None), (None, 10.3, 40.5, 7)], "town string, lat double, lon double, population long")
    found = places.settle(spots, towns.unionByName(small))
    rows = {r["id"]: (r["town"], r["rule"]) for r in found.collect()}
    assert len(rows) == found.count() == 299 and set(rows.values()) == {("t007", 1)}
    alone = places.settle(spots.where("lon > 30"), towns.unionByName(small)).collect()
    assert [(r["town"], r["rule"]) for r in alone] == [("a", 2)]
    assert most_rows(found) < 10_000


def test_postings_cross_in_lists(spark):
    """500 documents of the same five words: 2500 postings of two fields, ten lists a task."""
    docs = spark.range(500).coalesce(1).select("id", F.lit("a b c d e").alias("title"), F.lit("a b c d e a").alias("text"))
    lists = inverted._gathered(docs, "id", ("title", "text"))
    rows = lists.collect()
    assert len(rows) == 10 and sum(len(r["keys"]) for r in rows) == 5000
    a = next(r for r in rows if (r["field"], r["term"]) == ("text", "a"))
    assert a["keys"] == list(range(500)) and a["at"] == [[0, 5]] * 500 and set(a["words"]) == {6} and a["total"] == 1000


def test_pieces_come_in_small_batches(spark):
    """Pieces of 1000 long texts leave Python whole; null and empty texts have none."""
    docs = spark.range(1000).coalesce(1).select("id", F.repeat(F.lit("word "), F.lit(500)).alias("text"))
    cut = chunking.chunk(docs, key="id")
    assert cut.count() == 1000 * len(chunking.overlapping("word " * 500))
    odd = chunking.chunk(spark.createDataFrame([(1, None), (None, "x"), (2, "")], "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["n"], r["text"]) for r in odd] == [(None, 0, "x")]


def test_block_is_packed_by_itself():
    """Each block leaves the packing step in a batch of its own, so that one block's records are Python objects at a time."""
    b = pa.RecordBatch.from_pydict({"block": [0, 1, 2], "n": [1, 2, 1], "records": [["x"], ["y", "é"], [""]], "keys": [[1], [2, 3], [4]]})
    out = list(blocks._packed(iter([b])))
    assert [x.num_rows for x in out] == [1, 1, 1]
    assert [json.loads(zlib.decompress(x.column("payload")[0].as_py())) for x in out] == [["x"], ["y", "é"], [""]]


def test_files_of_large_rows_hold_few(spark):
    """A reader holds a file's rows together, so blocks of megabytes lie eight in a file."""
    of = materialise(spark.range(40).coalesce(1), "few", most=8)
    assert len(of.inputFiles()) == 5 and of.count() == 40


def test_costly_rows_are_dealt(spark, sf_dir):
    """One small file is one task's; its rows are worked on by as many tasks as shuffles have."""
    for query in (wordings.restored_contractions, answers.worked_steps):
        assert query(spark, sf_dir).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_pairs_compared_do_not_cross(spark, monkeypatch):
    """8192 rows, each twice, against 82 queries of 400: what leaves the comparing tasks is the best of each; more groups and parts find the same, and copies tie by key."""
    e = spark.range(8192).coalesce(1).select(F.col("id").alias("vec_id"), F.array(F.cos(F.col("id") % 4096), F.sin(F.col("id") % 4096)).cast("array<float>").alias("embedding"))
    found = vectors.exact_of_all(e, e.where("vec_id % 100 = 0"), 400)
    rows = found.collect()
    assert len(rows) == 82 * 400 == most_rows(found, "pythonNumRowsReceived")
    best = sorted((r for r in rows if r["query_id"] == 100), key=lambda r: (-r["score"], r["vec_id"]))
    assert best[0]["vec_id"] == 4196 and all(a["vec_id"] + 4096 == b["vec_id"] for a, b in zip(best[1:399:2], best[2:399:2], strict=True))
    monkeypatch.setattr(vectors, "HELD", 16_000)
    monkeypatch.setattr(vectors, "PART", 3000)
    again = vectors.exact_of_all(e, e.where("vec_id % 100 = 0"), 400).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_costly_customers_are_dealt(spark, sf_dir):
    """Pages with tables of numbers, and hours read into timelines: one small file is dealt to as many tasks as shuffles have."""
    for made in (collections._pages, travel._timed):
        assert made(spark, sf_dir).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_texts_without_terms_stay(spark, monkeypatch):
    """Where terms are too large to be sent to 400 texts, the keys of the 4 that have any still are, and the others' texts are not shuffled."""
    long = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(300)), lambda i: F.concat(F.lit("w"), F.translate(F.md5(F.concat(F.col("id"), F.lit("/"), i)), "0123456789", "ghijklmnop"))))
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 4, F.concat(F.lit("zanzibarite a@b.org "), long)).otherwise(long).alias("text"))
    want = sorted(map(str, pii.personal_data(docs).collect()))
    moved = []

    def written(df, name, most=0):
        if name == "spoken":
            moved.append(most_rows(df, "shuffleBytesWritten"))
        return materialise(df, name, most)

    monkeypatch.setattr(pii, "materialise", written)
    monkeypatch.setattr(pii, "fits", lambda df, n: not {"terms", "term"} & set(df.columns) and fits(df, n))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(str, pii.personal_data(docs).collect())) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum("start=0, end=11" in w for w in want) == 4 and 0 < moved[0] < 200_000


def test_only_first_words_are_split_off(spark, sf_dir):
    """Two words of a text are asked for, so a text is cut in three pieces at most."""
    plan = travel.guide_sections(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert r"split(text" in plan and r"\s+, 3)" in plan and "transform" not in plan


def test_words_are_hashed_once(monkeypatch):
    """Features are counts of hashed words, pairs and runs, as by their definition; of words met before only pairs are hashed."""
    text, size = "The fjörd, the FJÖRD of ab the fjörd", 64
    words = "the fjörd the fjörd of ab the fjörd".split()
    said = [f"w:{w}" for w in words] + [f"b:{a} {b}" for a, b in zip(words, words[1:], strict=False)] + [f"c:^{w}$"[:2] + f"^{w}$"[i : i + k] for w in words for k in (3, 4, 5) for i in range(len(w) + 3 - k)]
    counts = {}
    for x in said:
        counts[hashing.fnv1a(x) % size] = counts.get(hashing.fnv1a(x) % size, 0) + 1
    length = sum(n * n for n in counts.values()) ** 0.5
    assert list(hashing.features(text, size).items()) == [(i, n / length) for i, n in counts.items()]
    hashed, plain = [], hashing.fnv1a
    monkeypatch.setattr(hashing, "fnv1a", lambda *given: hashed.append(given[0]) or plain(*given))
    hashing.features(text, size)
    assert hashed == words[1:]


def test_telling_words_stand_for_texts(spark, sf_dir):
    """Passages that meet many questions carry the words that terms find, not their texts, and are judged alike."""
    assert "text" not in evidence._judged(spark, sf_dir).columns
    texts = [(1, "Granites weather; graniteware"), (2, "gran granit GRANITE"), (3, "ab 12345 1234567"), (4, "abc"), (5, None), (6, ""), (7, "hardness hard"), (8, "naïveté naïve")]
    asked = [(1, "granite hardness"), (2, "ab 1234"), (3, "What is granite hardness and how does it weather slowly?"), (4, "naïve naïveté")]
    docs, questions = spark.createDataFrame(texts, "doc_id int, text string"), spark.createDataFrame(asked, "q int, question string")
    terms = questions.select(F.explode(query_terms(F.col("question"))).alias("t"))
    spoken = docs.select("doc_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("w"))
    told = coverage.telling(spoken, terms, "w", "t")
    assert {(r["doc_id"], r["w"]) for r in told.collect()} == {(1, "granites"), (1, "weather"), (1, "graniteware"), (2, "granite"), (3, "ab"), (7, "hardness"), (8, "naïveté"), (8, "naïve")}
    held = docs.join(told.groupBy("doc_id").agg(F.collect_list("w").alias("w")), "doc_id", "left").withColumn("w", F.coalesce("w", F.array().cast("array<string>")))
    rows = held.crossJoin(questions.select("q"))
    columns = ["q", "doc_id", "eligible", "covers", "parts", "clauses"]
    assert sorted(map(repr, coverage.judged(rows, questions, "q", words="w").select(columns).collect())) == sorted(map(repr, coverage.judged(rows, questions, "q").select(columns).collect()))


def test_like_lines_are_not_compared_in_all_pairs(spark, monkeypatch):
    """30 like lines and every pair of them: each is compared with one other; a line like only its last partner is found too, and an unlike one is compared with all."""
    words = [f"w{i}" for i in range(20)]
    said = [" ".join(words[:19] + [f"x{n}"]) for n in range(30)] + ["quite another line", " ".join(["y"] * 3 + words[:17]), "quite another line"]
    docs = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    pairs = [(y, 0, x, 0) for y in range(33) for x in range(y)]
    compared, plain = [], lines._alike
    monkeypatch.setattr(lines, "_alike", lambda pairs, *given: compared.append(pairs.count()) or plain(pairs, *given))
    found = lines._verified(spark.createDataFrame(pairs, "y_doc_id long, y_ln int, x_doc_id long, x_ln int"), docs, 80, 1000)
    assert {r["doc_id"] for r in found.collect()} == {*range(1, 30), 31, 32} and found.count() == len(set(found.collect()))
    assert compared[0] == 32 and sum(compared) <= 32 + 2 * 32
    none = lines._verified(spark.createDataFrame([], "y_doc_id long, y_ln int, x_doc_id long, x_ln int"), docs, 80, 1000)
    assert none.count() == 0


def test_texts_of_equal_entities_share_their_terms(spark):
    """Terms are listed once for each set of entities that texts hold; entities without terms don't tell sets apart."""
    texts = [(n, f"mail ann@shared.org about quokka marsupials, copy {'abcdefghij'[n] * 4}") for n in range(8)] + [(8, "mail ann@shared.org and +49 171 555 0199 on quokka"), (9, "nothing here"), (10, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = materialise(pii.values(docs), "values")
    told = spark.createDataFrame([("email:ann@shared.org", "quokka"), ("email:ann@shared.org", "marsupials"), ("email part:shared.org", "quokka")], "entity string, term string")
    for most in (0, 1000):
        keys, sets = pii._told(found, told, most)
        assert [r["terms"] for r in sets.collect()] == [["marsupials", "quokka"]]
        assert {r["key"] for r in keys.collect()} == {r["key"] for r in found.where("doc_id <= 8").collect()} and keys.select("set").distinct().count() == 1


def test_steps_met_before_are_remembered(spark, sf_dir):
    """500 texts of the same three steps are three steps to read, in no lambda of the engine's; figures that pass doubles or 32 bits end no query, and letters of two UTF-16 units are letters."""
    plan = answers.worked_steps(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "lambda" not in plan
    steps._read.cache_clear()
    text = "So 28 boxes × €7.33 = €206.24.\nThen €206.24 + €0.37 = €206.61; not 2 × 3 × 4 = 25.\nArrival: 08:15 + 6 h 30 min = 14:45."
    want = [(205.24, False, "28 boxes × €7.33 = €205.24"), (205.61, False, "€205.24 + €0.37 = €205.61"), (885.0, True, "08:15 + 6 h 30 min = 14:45")]
    assert all([s[2:] for s in steps.worked(text)] == want for _ in range(500)) and steps._read.cache_info().misses == 3
    odd = spark.createDataFrame([(1, "9" * 400 + " + 1 = 2"), (2, "3000000000 min + 1 min = 5 min"), (3, "𝔸5 × 2 = 11; 5 𝔸 × 2 = 11 𝔸"), (4, None), (5, "5 ×\n2 = 11")], "k int, t string")
    rows = sorted(map(tuple, steps.listed(odd, "k", "t").collect()))
    assert rows == [(2, 1, 3000000001.0, False, "3000000000 min + 1 min = 50000000 h 1 min"), (3, 1, 10.0, False, "5 𝔸 × 2 = 10 𝔸")]
    found = odd.select("k", steps.steps(F.col("t")).alias("s")).collect()
    assert [None if r["s"] is None else len(r["s"]) for r in sorted(found)] == [0, 1, 1, None, 0]
