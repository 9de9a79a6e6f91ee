"""Words and their forms, evidence and further calculations, by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import calculators as calc
from siltstone.functions import wording
from siltstone.operators import budget
from siltstone.plans import wordings


def each(spark, f, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.select(f(F.col("v")).alias("x"), "i").orderBy("i").select("x").collect()]


def test_spellings(spark):
    words = ["colours", "flour", "centres", "catalogue", "licence", "paediatric", "oesophagus", "tour", "B2-our", None, "neighbourhood"]
    assert each(spark, wording.american, words) == ["colors", "flour", "centers", "catalog", "license", "pediatric", "esophagus", "tour", "B2-our", None, "neighborhood"]


def test_contractions(spark):
    texts = ["whats up", "WHATS UP", "Whats up, im here", "IM dONT DOnt", "image cantor", None, ""]
    assert each(spark, wording.contracted, texts) == ["what's up", "WHAT'S UP", "What's up, I'm here", "I'M don't Don't", "image cantor", None, ""]


def test_stems_and_codes(spark):
    assert each(spark, wording.coarse_stem, ["berries", "tides", "cats", "bus", "walking", "red", "faded"]) == ["berri", "tid", "cat", "bus", "walk", "red", "fad"]
    assert each(spark, wording.coded_terms, ["A K-9 unit walking", "", None]) == [["9", "unit", "walk", "k9"], [], None]


def test_aliases(spark):
    rows = spark.createDataFrame([("Hurricane", ["Huricane", "Tropical cyclone", "TropicalCyclone", "123", "Tropical cyclones", "Storm"])], "t string, a array<string>")
    assert rows.select(wording.useful_aliases(F.col("t"), F.col("a"))).first()[0] == ["Tropical cyclone", "Storm"]


def test_labels_by_utf16_units(spark):
    wide = "x" * 94 + "😀😀"
    assert each(spark, wording.compact, ["a" * 96, "a" * 97, wide, "x" * 95 + "😀", "😀" * 60, "", None]) == ["a" * 96, "a" * 95 + "…", "x" * 94 + "…", "x" * 95 + "…", "😀" * 47 + "…", "", None]


def test_evidence(spark):
    rows = spark.createDataFrame([("a", 1, 50), ("a", 2, 70), ("a", 3, 40), ("a", 4, 10), ("a", 5, 0), ("b", 1, 101)], "pack string, rank int, n int")
    got = budget.evidence(rows, "pack", "rank", "n", 100, 3).select("pack", "rank", "place").collect()
    assert sorted(map(tuple, got)) == [("a", 1, 1), ("a", 3, 2), ("a", 4, 3)]
    assert budget.evidence(rows.limit(0), "pack", "rank", "n", 100, 3).count() == 0


def test_calculations(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    n = F.lit
    assert one(calc.fuel_range(n(50.0), n(8.0))) == 625 and one(calc.fuel_range(n(50.0), n(0.0))) is None
    assert one(calc.travel_hours(n(120.0), n(60.0))["whole"]) == 2 * 7 / 6 and one(calc.travel_hours(n(120.0), n(60.0), n(30))["whole"]) == 2.5
    assert one(calc.per_unit(n(3.0), n(0.0))) is None and one(calc.scaled(n(200.0), n(4), n(6))) == 300 and one(calc.percent(n(80.0), n(15))) == 12


def test_evidence_of_long_lists(spark, tmp_path):
    """Short passages behind many too long ones still enter, with the rank they have among all; of a long list only what can enter meets, and a fold over the whole list gives the same."""
    texts = [("a", i, "nation " * 500) for i in range(40)] + [("a", 40, "nation " + "word " * 20), ("a", 41, "nation " + "word " * 30), ("b", 42, "nation"), ("b", 43, "none")]
    spark.createDataFrame(texts, "source string, doc_id long, text string").selectExpr("doc_id", "source", "'' AS title", "text").write.parquet(str(tmp_path / "documents.parquet"))
    got = wordings.evidence_packing(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [("a", 40, 41, 1), ("a", 41, 42, 2), ("b", 42, 1, 1)]

    sizes = [(i * 7919 + i * i) % 130 for i in range(3000)]
    want = {}
    for key in range(3):
        used, kept = 0, []
        for i, n in enumerate(sizes):
            if i % 3 == key and len(kept) < 4 and used + n <= 100:
                used, kept = used + n, [*kept, i]
        want |= {(str(key), i): place for place, i in enumerate(kept, 1)}
    rows = spark.createDataFrame([(str(i % 3), i, n) for i, n in enumerate(sizes)] + [("0", -1, None), (None, 1, 1)], "pack string, rank int, n int")
    assert {(r["pack"], r["rank"]): r["place"] for r in budget.evidence(rows, "pack", "rank", "n", 100, 4).collect()} == want
