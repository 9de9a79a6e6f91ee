"""Steps of arithmetic, parts of questions, merges keyed by question, depth, against cases by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import steps
from siltstone.operators import coverage, depth, merge, running


WORKED = [
        ("15% × €200 = €30", [(30.0, True)]), ("15% × 20% = 3%", [(3.0, True)]), ("15% × 20% = 0.03", [(0.03, True)]), ("20 ÷ 100 = 20%", [(20.0, True)]), ("15% ÷ 5% = 3", [(3.0, True)]), ("15 cm + 15 m = 30 cm", []),
        ("420 km ÷ 140 km/h = 3 h", [(180.0, True)]), ("3 h + 20 min = 3 h 20 min", [(200.0, True)]), ("23:30 + 45 min = 00:15", [(15.0, True)]), ("00:10 - 23:50 = 20 min", [(20.0, True)]), ("45 minutes × 3 = 2 h", [(135.0, False)]),
        ("€200 - 15% = €170", [(170.0, True)]), ("2 x 4 = 9", [(8.0, False)]), ("2 × 4 nights × €3.50 = €28.00", []), ("685.44 + 0 = 685", [(685.44, True)]), ("3 × 0.2 = 1", [(0.6, False)]), ("1,200 * 3 = 3,600", [(3600.0, True)]),
        ("7 / 0 = 3", []), ("25:99 + 1 h = 3:00", []), ("5 × 5 = €20\n$20 + $3 = $23", [(25.0, False), (23.0, True)]), ("4 × 6 = 25\n25 + 3 = 28", [(24.0, False), (27.0, False)]), ("no sums here", []), (None, None),
    ]


def test_steps(spark):
    df = spark.createDataFrame(list(enumerate(t for t, _ in WORKED)), "n int, t string")
    got = [r["s"] for r in df.select("n", steps.steps(F.col("t")).alias("s")).orderBy("n").collect()]
    assert [None if g is None else [(round(s["value"], 6), s["right"]) for s in g] for g in got] == [w for _, w in WORKED]


def test_corrections(spark):
    said = {
        "Cost: 8 pizzas × €11.50 = €93.00.": "Cost: 8 pizzas × €11.50 = €92.00 (corrected).", "4 × 6 = 25\n25 + 3 = 28": "4 × 6 = 24 (corrected)\n24 + 3 = 27 (corrected)", "07:15 + 1 h 50 min = 9:15": "07:15 + 1 h 50 min = 9:05 (corrected)", "10 ÷ 4 = 2": "10 ÷ 4 = 2.5 (corrected)",
        "€10 ÷ 4 = €3": "€10 ÷ 4 = €2.50 (corrected)", "1,500 × 2 = 3,100": "1,500 × 2 = 3,000 (corrected)", "all is well: 2 + 2 = 4": "all is well: 2 + 2 = 4", "4 × 5 = 25\n25 + 3 = 28": "4 × 5 = 20 (corrected)\n25 + 3 = 28",
    }
    df = spark.createDataFrame([(t, "A group of 25 with more." if t.startswith("4 × 5") else None) for t in said], "t string, q string")
    found = steps.steps(F.col("t"), F.coalesce("q", F.lit("")))
    assert {r["t"]: r["c"] for r in df.select("t", steps.corrected(F.col("t"), found).alias("c")).collect()} == said


def test_clauses(spark):
    def parts(q):
        return spark.createDataFrame([(q,)], "q string").select(coverage.clauses(F.col("q"))).first()[0]

    assert parts("What is a quokka habitat and how does the quokka breed?") == ["What is a quokka habitat", "how does the quokka breed?"]
    assert parts("Why do tides change? When are spring tides; where do neap tides occur?") == ["Why do tides change", "When are spring tides", "where do neap tides occur?"]
    assert parts('What is "salt and how it rusts" made of') == [] and parts("Tell me about salt and how iron rusts") == [] and parts("What is (unclosed salt and how does iron rust?") == []
    assert parts("What is salt and what is it?") == [] and parts("") == [] and parts("What is iron ore " + "x" * 2000 + " and how does iron rust?") == []


def test_required_evidence(spark):
    q = spark.createDataFrame([(1, "What is granite hardness and how does granite weather?"), (2, "marble quarry carrara"), (3, "nothing matches anything whatever")], "q int, question string")
    c = [(1, "p", 10, 9.0, "Granite has a hardness of six"), (1, "p", 11, 8.0, "It will weather slowly"), (1, "r", 12, 7.0, "Granite weathers into sand; hardness falls"), (1, "r", 13, 1.0, None), (2, "p", 20, 5.0, "The quarry of marble"), (2, "p", 21, 9.0, "A quarry"), (2, "r", 22, 2.0, "Carrara marble quarry")]
    rows = coverage.judged(spark.createDataFrame(c, "q int, pack string, doc_id int, score double, text string"), q, "q")
    got = {(r["q"], r["doc_id"]): (r["eligible"], r["covers"], list(r["parts"])) for r in rows.collect()}
    assert got[1, 10] == (True, False, [True, False]) and got[1, 12][2] == [True, True] and not got[1, 11][0] and not got[1, 13][0]
    assert got[2, 20] == (True, False, []) and not got[2, 21][0] and got[2, 22] == (True, True, [])
    merged = sorted((r["q"], r["rank"], r["doc_id"], r["tier"]) for r in coverage.merge_relevant(rows, 8, "q").collect())
    assert merged == [(1, 1, 12, 1), (1, 2, 10, 2), (2, 1, 22, 2), (2, 2, 20, 2)]


def test_merges_of_many_questions(spark):
    runs = [(q, p, f"{p}{n}", 10.0 * (p == "a") + 5 - n) for q in (1, 2) for p in "abc" for n in range(5)] + [(1, "c", "a0", 9.0)]
    df = spark.createDataFrame(runs, "q int, pack string, doc_id string, score double")
    every = {(r["q"], r["rank"]): r["doc_id"] for r in merge.merge(df, 7, by=["q"]).collect()}
    for q in (1, 2):
        alone = {(q, r["rank"]): r["doc_id"] for r in merge.merge(df.where(F.col("q") == q), 7).collect()}
        assert alone == {k: v for k, v in every.items() if k[0] == q} and len(alone) == 7
    first = [r["doc_id"] for r in merge.merge(df, 7, by=["q"], priority=F.col("doc_id") == "b4").where("q = 2").orderBy("rank").collect()]
    assert first[0] == "b4"
    vec, key = df.where("pack = 'b'"), df.where("pack <> 'c'")
    fused = [r["doc_id"] for r in merge.fuse(vec, key, by=["q"]).where("q = 2").orderBy("rank").collect()]
    assert fused == [f"b{n}" for n in range(5)] + [f"a{n}" for n in range(5)]


def test_depth(spark):
    """A section that answers "why" comes before the rest of the lead; an opening piece that doesn't fit is cut at a sentence; what doesn't fit its share waits."""
    lead = "A tide is a rise of the sea. " * 20
    p = [("Tide", 1, n, True, "", lead) for n in range(2)] + [("Tide", 2, 0, False, "History", "Old. " * 60), ("Tide", 3, 0, False, "Causes", "The moon pulls. " * 20), ("Tide", 3, 1, False, "Causes", "The moon pulls. " * 20), ("Tide", 4, 0, False, "Sources", "PMID 1 PMID 2 PMID 3"), ("Moon", 9, 0, True, "", "Short. " * 100)]
    passages = spark.createDataFrame(p, "article string, doc long, n int, lead boolean, heading string, text string")
    s = spark.createDataFrame([(1, "Why is there a tide?", "Tide", 0, 1200), (1, "Why is there a tide?", "Moon", 1, 300)], "q int, question string, article string, slot int, share int")
    ranked = depth.ranked(passages, s, "q")
    order = [(r["doc"], r["n"]) for r in ranked.where("slot = 0").orderBy("place").collect()]
    assert order == [(1, 0), (3, 0), (3, 1), (1, 1), (2, 0)]
    picked = [(r["doc"], r["n"], r["size"]) for r in depth.pick(ranked, passages, "q", 1500).orderBy("turn").collect()]
    assert picked == [(1, 0, 580), (9, 0, 300), (3, 0, 320), (3, 1, 320)]
    texts = [(r["doc"], r["first"], r["last"], r["text"]) for r in depth.joined(depth.pick(ranked, passages, "q", 1500), passages, "q").orderBy("place").collect()]
    assert [t[:3] for t in texts] == [(1, 0, 0), (9, 0, 0), (3, 0, 1)] and texts[2][3].startswith("The moon pulls.")
    assert [r[0] for r in spark.createDataFrame([(None,), (10.0,), (30.0,), (90.0,)], "v double").select(depth.budget(F.col("v"))).collect()] == [2000, 1000, 2400, 3600]


def test_running(spark):
    rows = spark.range(0, 1000, 1, 7).withColumn("v", (F.col("id") * 37 % 101).cast("int"))
    got = running.numbered(rows, [F.desc("v"), F.col("id")], "place").orderBy("place").collect()
    want = sorted(((i * 37 % 101, i) for i in range(1000)), key=lambda x: (-x[0], x[1]))
    assert [(r["v"], r["id"], r["place"]) for r in got] == [(v, i, n + 1) for n, (v, i) in enumerate(want)]
    sums = running.summed(rows, [F.col("v"), F.col("id")], "v", "before").orderBy("v", "id").collect()
    total = 0
    for r in sums:
        assert r["before"] == total
        total += r["v"]
    assert running.numbered(rows.limit(0), [F.col("id")], "place").count() == 0


def test_ordered_rules(spark):
    from siltstone.operators import rules

    given = (rules.Rule("burn", all=(r"\bburn",), none=("history", "sun")), rules.Rule("sun", any=("sunburn", r"burn\w* by the sun")), rules.Rule("any", all=("a",), any=("b", "c")))
    said = {"Burnt my hand": "burn", "history of BURNS": None, "burned by the sun": "sun", "a": None, "cab": "any", "": None, None: None}
    rows = spark.createDataFrame([(t,) for t in said], "t string").select("t", rules.named(F.col("t"), given).alias("r")).collect()
    assert {r["t"]: r["r"] for r in rows} == said
    texts = spark.createDataFrame([(1, ["burn", "hand", "burn"]), (2, []), (3, None), (4, ["snake", "hand"])], "id int, w array<string>")
    words = spark.createDataFrame([("burns", "burn"), ("burns", "hand"), ("burns", "hand"), ("bites", "snake")], "name string, word string")
    assert sorted(tuple(r) for r in rules.ranked(texts, words, "w", "id").collect()) == [(1, "burns", 2), (4, "bites", 1), (4, "burns", 1)]


def test_zone_clocks(spark):
    from siltstone.functions.calculators import zone_clock

    cases = [("2024-07-01 12:00:00", "Europe/Paris", "2024-07-01", 840, 120), ("2024-01-01 23:30:00", "Europe/Paris", "2024-01-02", 30, 60), ("2024-01-01 01:00:00", "America/New_York", "2023-12-31", 1200, -300), ("2024-05-05 00:00:00", "Asia/Kolkata", "2024-05-05", 330, 330), (None, "Asia/Kolkata", None, None, None)]
    df = spark.createDataFrame([(n, t, z) for n, (t, z, *_) in enumerate(cases)], "n int, t string, z string")
    got = df.select("n", zone_clock(F.col("t").cast("timestamp"), F.col("z")).alias("c")).orderBy("n").collect()
    assert [(None if r["c"]["day"] is None else str(r["c"]["day"]), r["c"]["minute"], r["c"]["ahead"]) for r in got] == [tuple(c[2:]) for c in cases]
