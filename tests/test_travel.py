"""Destinations, opening hours, guides, tables, paired dumps and selection, against cases by hand."""

from __future__ import annotations

import bz2
import json

import pytest
from pyspark.sql import functions as F

from siltstone.functions import hours, relevance
from siltstone.functions.labels import heading_path
from siltstone.functions.text import query_terms
from siltstone.operators import destinations, emergency, listings, selection
from siltstone.sources import guides, paired
from siltstone.sources.html import table_rows, tables


def test_phrases():
    named = lambda q: {p for _, _, p in destinations.spans(q)}
    assert "budapest" in named("where to eat in budapest") and {"Rio de Janeiro", "Rio", "Janeiro"} <= named("Is Rio de Janeiro safe?")
    assert "Frankfurt am Main" in named("Hotels near Frankfurt am Main, please") and named("Which museum is best?") == set() and named("What about the morning in the end?") == set()
    assert "of Wight" not in named("Isle of Wight ferries") and "Isle of Wight" in named("Isle of Wight ferries")
    assert not any("Madrid" in p and "Paris" in p for p in named("Paris, Madrid")) and named("") == set()
    assert len(list(destinations.spans("New York City " * 5000))) < 200_000


def test_resolution(spark):
    titles = spark.createDataFrame([(1, "Mexico City/Centro — Street food alley"), (2, "Mexico — Beaches"), (3, "City — Walls"), (4, "Zürich — Kunsthaus"), (5, "Nice — Promenade"), (6, "untitled"), (7, None), (8, "Rio de Janeiro — Swimming")], "id int, title string")
    q = spark.createDataFrame([(1, "What is nice in Mexico City, and in zurich?"), (2, "Is Rio de Janeiro near Mexico? And MEXICO again in mexico"), (3, "nothing here"), (4, None), (5, "In Nice")], "q int, text string")
    found = destinations.resolve(q, titles, ["q"])
    assert sorted((r["q"], r["place"], r["destination"]) for r in found.collect()) == [(1, 1, "Mexico City"), (1, 2, "zurich"), (2, 1, "Rio de Janeiro"), (2, 2, "Mexico"), (5, 1, "Nice")]
    assert sorted((r["q"], r["id"]) for r in destinations.scoped(found, titles).collect()) == [(1, 1), (1, 4), (2, 2), (2, 8), (5, 5)]
    assert destinations.resolve(q, titles.limit(0), ["q"]).count() == 0


WEEK = "Mo-Fr 08:00-13:00; PH off, Mo-Fr 14:00-18:30"


@pytest.mark.parametrize(
    ("text", "day", "minute", "want"),
    [
        (WEEK, 2, 540, ("open", 780)), (WEEK, 2, 810, ("closed", None)), (WEEK, 2, 850, ("open", 1110)), ("Fr 18:00-02:00", 4, 1200, ("open", None)), ("Fr 18:00-02:00", 5, 60, ("open", 120)), ("Su 22:00-03:00", 0, 100, ("open", 180)), ("18:00+", 0, 1140, ("open", None)),
        ("Mo 10:00-12:00+", 0, 800, ("unknown", None)), ("Mo 18:00+", 1, 60, ("unknown", None)), ("Mo 18:00+; Tu 09:00-10:00", 1, 545, ("open", 600)), ("Mo 18:00+; Tu 09:00-10:00", 1, 700, ("closed", None)), ("24/7", 6, 0, ("open", None)), ("sunrise-sunset", 0, 600, ("unknown", None)),
        (None, 0, 0, ("unknown", None)), ("", 0, 0, ("unknown", None)), ("Mo-Su 09:00-17:00; We off", 2, 600, ("closed", None)), ("Mo 25:00-26:00", 0, 0, ("unknown", None)), ("Mo-Fr 08:00-12:00, Sa off", 5, 600, ("closed", None)), ("Sa-Mo 10:00-11:00", 6, 605, ("open", 660)), ("Mo-PH 10:00-11:00", 0, 605, ("unknown", None)),
    ],
)
def test_hours(spark, text, day, minute, want):
    at = F.lit(day * 1440 + minute)
    line = hours.read(F.col("t"))
    assert tuple(spark.createDataFrame([(text,)], "t string").select(hours.state(line, at), hours.until(line, at)).first()) == want


def test_guide_hours():
    said = {"Daily 11:00-22:00": "11:00-22:00", "M-F 07:00-18:00, Sa Su 07:00-15:00": "Mo-Fr 07:00-18:00, Sa,Su 07:00-15:00", "Tu-Sa 07:00-12:00 and 15:00-19:00": "Tu-Sa 07:00-12:00, 15:00-19:00", "7AM-3:30PM": "07:00-15:30", "Open every day: noon-midnight": "12:00-24:00", "Mondays 12am-12pm": "Mo 00:00-12:00", "lunch Th-Sa": "lunch Th-Sa"}
    assert {k: hours.plain(k) for k in said} == said and hours.plain(None) is None


def test_ranges(spark):
    line = hours.read(F.lit("Sa 22:00-04:00, Sa 23:00-02:00; Su 20:00-06:00"))
    row = spark.range(1).select(hours.union(line["open"]).alias("u"), hours.minutes(line["open"], F.lit(0), F.lit(720)).alias("m"), hours.during(line, F.lit(0), F.lit(100)).alias("d"), hours.during(line, F.lit(400), F.lit(500)).alias("c")).first()
    assert [tuple(r) for r in row["u"]] == [(0, 360), (8520, 8880), (9840, 10080)] and (row["m"], row["d"], row["c"]) == (360, "open", "closed")


def test_templates():
    said = {
        "{{EUR|25}} for {{km|{{frac|1|2}}}}": "EUR 25 for 1/2 km", "{{c|20}} {{mile|3}} {{usd}}": "20°C 3 miles USD", "{{convert|5|ft|m}} {{frac|1|2|3}} {{frac|4}} {{rint|x|m1}}": "5 ft 1 2/3 1/4 M1", "{{marker|name=Old [[Town|city]]|lat=1}}": "Old [[Town|city]]", "{{unknown|{{m|3}}}}": "",
        "{{warningbox|Beware|boldtext=Hot}}": "\nWarning: Hot. Beware\n", "{{cautionbox|1=Mind}}": "\nCaution: Mind\n", "{{see|name=Zoo|alt=Big|content=Nice {{m|3}}}}": "\n- Zoo: Big Nice 3 m\n", "{{see|alt=no name}}": "", "open {{km|3": "open km|3", "}} x": " x", "{{nowrap|a|b}}": "a b", "{{Pull_quote|so}}": "so",
    }
    assert {k: guides.expanded(k) for k in said} == said
    assert guides.expanded("{{see|name=Zoo}}", False) == "" and guides.expanded("{{nowrap|" * 500 + "x" + "}}" * 500) == "x"
    text = "a <!-- {{m|1}} --> b<ref>z</ref> [[File:x.jpg|cap [[l|m]] {{m|2}}]]''it'' &amp; [http://a.b label] http://c.d\n* item [[x|y]]\n__TOC__\n{|\n| cell\n|}\n<b>end</b>"
    assert guides.readable(text) == "a b it & label\n- item y\n\nend"


def test_guide_sections(spark):
    text = "Lead text\n== See ==\n{{see|name=Zoo}}\nWorth a day\n=== Parks ===\nGreen\n== Get in ==\n{{marker|name=By bus}} often\n==== Night ====\nLate"
    pages = spark.createDataFrame([(7, "Town", text), (8, "Gone", "#REDIRECT [[Town]]"), (9, "Many", "{{disamb}} x"), (10, None, None)], "page_id long, title string, text string")
    got = [(r["document_id"], r["title"], r["text"]) for r in guides.documents(pages, least=1).orderBy("document_id").collect()]
    assert got == [("guide-7-0000", "Town — Overview", "Lead text"), ("guide-7-0001", "Town — See", "Worth a day"), ("guide-7-0002", "Town — See > Parks", "Green"), ("guide-7-0003", "Town — Get in", "By bus often"), ("guide-7-0004", "Town — Get in > Night", "Late")]


def test_table_grids(spark):
    page = "<h2>One</h2><table class='wikitable'><tr><th rowspan=2>a</th><th colspan=2>b<table><tr><td>in</td></tr></table></th></tr><tr><td>c</td><td>d<sup class='reference'>9</sup></td></tr><tr><td colspan=x>e</td></tr></table>"
    assert tables(page) == [("One", ["wikitable"], [[("a", 1), ("b in", 2), ("b in", 2)], [("a", 1), ("c", 1), ("d", 1)], [("e", 1), ("", 1), ("", 1)]])]
    assert tables(None) == [] and tables("<table>") == [("", [], [])]
    head = "<table class=wikitable><tr><th>Country</th><th>Police</th><th>Ambulance</th><th>Fire</th><th>Notes</th></tr>"
    rows = [(1, head + "<tr><td>Norway</td><td colspan=3>112</td><td>Police – 02800; Fire brigade – 110 or 112. State Emergency – 5</td></tr><tr><td>Nowhere</td><td>1</td><td>1</td><td>1</td><td></td></tr><tr><td>Peru</td><td>105 and 106</td><td>ask</td><td></td><td></td></tr></table>")]
    codes = spark.createDataFrame([("norway", "NO"), ("Peru", "PE")], "name string, code string")
    of = lambda html: emergency.numbers(table_rows(spark.createDataFrame(html, "page_id int, html string")), codes)
    got = {r["code"]: (r["police"], r["ambulance"], r["fire"], r["general"], r["unread"]) for r in of(rows).collect()}
    assert got == {"NO": (["112", "02800"], ["112"], ["112", "110"], ["112"], []), "PE": (["105", "106"], [], [], [], ["ambulance"])}
    with pytest.raises(Exception, match="not a table of numbers"):
        of([(1, "<table class=wikitable><tr><th>Land</th></tr></table>")]).collect()
    with pytest.raises(Exception, match="rows that differ for PE"):
        of([(1, head + "<tr><td>Peru</td><td>1</td><td>1</td><td>1</td></tr></table>"), (2, head + "<tr><td>Peru</td><td>2</td><td>1</td><td>1</td></tr></table>")]).collect()


def _paired(ids, wrong=None):
    return "".join(json.dumps({"index": {"_id": str(i)}}) + "\n" + json.dumps({"page_id": i if i != wrong else i + 1, "text": "x" * (i % 400) + "é"}) + "\n" for i in ids)


def test_paired_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text(_paired(range(1, 3000)))
    (tmp_path / "b.json.bz2").write_bytes(bz2.compress(_paired(range(3000, 3100)).encode()) + bz2.compress(_paired(range(3100, 3200)).encode()))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for split in ("7000", "20001", size):
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            found = paired.records(spark, str(tmp_path))
            assert sorted(r["id"] for r in found.collect()) == list(range(1, 3200))
            assert all(json.loads(r["record"])["page_id"] == r["id"] for r in found.collect()) and paired.repeated(found).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    bad = {"mismatch": _paired(range(1, 9), wrong=4), "no record": _paired(range(1, 4)) + '{"index": {"_id": "9"}}\n', "no index": _paired(range(1, 4)) + '{"page_id": 8}\n', "first": '{"page_id": 8}\n' + _paired(range(1, 4)), "twice": '{"index": {"_id": "9"}}\n' + _paired(range(1, 3)), "list": "[1]\n", "id": '{"index": {"_id": "0"}}\n{"page_id": 0}\n'}
    for name, text in bad.items():
        (tmp_path / f"{name}.bad").write_text(text)
        with pytest.raises(Exception):  # noqa: B017
            paired.records(spark, str(tmp_path / f"{name}.bad")).collect()


def test_selection(spark):
    docs = [(1, "Sun_Spot", "x" * 100), (2, "Moon", "x" * 1000), (3, "List of moons", "x" * 1500), (4, "List of suns", "x" * 3000), (5, "1984", "x" * 5000), (6, "Star", "x" * 900), (7, "Tiny", "x"), (8, None, None), (9, "Dune (1984 film)", "x" * 2000), (10, "Mars", "x" * 1000)]
    df = spark.createDataFrame(docs, "doc_id int, title string, text string")
    got = sorted((r["doc_id"], r["before"]) for r in selection.within_budget(df, spark.createDataFrame([("sun spot ",)], "title string"), 4200).collect())
    assert got == [(1, None), (2, 4100), (4, 100), (10, 3100)]


def test_listing_filters(spark):
    text = "Destination: Rio de Janeiro\nPlace: Sol\nType: cafe\nCategory: Food\nDescription: A quiet terrace\nOther: beach"
    df = spark.createDataFrame([(1, text, None, "Any cafe in Rio, not Sol?"), (2, text, "bank", "A beach in Rio"), (3, None, None, None), (4, "Category:  \nPlace: Luna", None, "rio listings")], "id int, text string, category string, q string")
    ids = lambda d: sorted(r["id"] for r in d.collect())
    assert ids(listings.of_categories(df, ["food"], "category")) == [1] and ids(listings.of_categories(df, ["FOOD"])) == [1, 2] and ids(listings.of_categories(df, ["bank"], "category")) == [2]
    fits = {r["id"]: r["f"] for r in df.where("q is not null").select("id", listings.fits(F.col("text"), query_terms(F.col("q"))).alias("f")).collect()}
    assert fits == {1: True, 2: False, 4: False}
    said = {"an ATM, not Euronet": ["euronet"], "Avoid the Ritz, except an Ibis and other than Kaya's": ["ritz", "ibis", "kaya's"], "not far from Rome": [], "no Al": [], "": []}
    rows = spark.createDataFrame([(q,) for q in said], "q string").select("q", listings.left_out(F.col("q")).alias("n")).collect()
    assert {r["q"]: list(r["n"]) for r in rows} == said
    assert ids(listings.kept(df.withColumn("name", F.lit("Café Sol")), "q")) == [2, 3, 4]
    assert ids(listings.above(df.withColumn("score", F.when(F.col("id") < 4, F.col("id") / 4.0)), 0.5)) == [2, 3]


def test_script_errors(spark):
    e = "Lua error in Module:N at line 88: attempt to call field '_t' (a nil value)."
    said = {f"{e} (日本) is a language. It is old.": "Tea (日本) is a language. It is old.", f"One. Two {e} three. Four.": "One. Four.", "Lua error in package.lua at line 80: module 'Module:P/s' not found. Fine.": "Fine.", "as  it is": "as  it is"}
    rows = spark.createDataFrame([(t,) for t in said], "t string").select("t", listings.without_script_errors(F.col("t"), F.lit("Tea")).alias("c")).collect()
    assert {r["t"]: r["c"] for r in rows} == said


def test_scopes_and_heading_paths(spark):
    df = spark.createDataFrame([("Zürich — Kunsthaus",), ("ZURICH/Altstadt — Bar",), ("Zurichsee — Boats",), (None,), ("Sun — Core > Fusion > Chain",), ("Sun",)], "t string")
    rows = df.select("t", relevance.scope(F.col("t"), "Zürich").alias("s"), heading_path(F.col("t")).alias("h")).collect()
    assert [r["s"] for r in rows] == [True, True, False, None, False, False]
    assert [(r["h"]["article"], list(r["h"]["above"]), r["h"]["own"]) for r in rows if r["t"]][3:] == [("Sun", ["Core", "Fusion"], "Chain"), ("Sun", [], None)]
