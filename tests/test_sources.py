"""Readers, writers and ingest on small files."""

from __future__ import annotations

import json

import pytest

from siltstone.functions import relevance
from siltstone.operators import lookup
from siltstone.sources import documents, packs, places, wiki
from siltstone.streaming import ingest

DOC = {"document_id": "a-1", "title": "T", "source": "s", "license": "CC0", "text": "ﬁrst\r\nline"}


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_documents(spark, tmp_path):
    path = put(tmp_path, "d.jsonl", "\n".join(json.dumps(d) for d in (DOC | {"document_id": "b"}, DOC)))
    assert [(r["document_id"], r["text"]) for r in documents.documents(spark, path).collect()] == [("a-1", "first\nline"), ("b", "first\nline")]


@pytest.mark.parametrize("line", ["", "{}", json.dumps(DOC | {"x": "1"}), json.dumps(DOC | {"title": " "}), json.dumps(DOC | {"document_id": "A"}), json.dumps(DOC)[:-1] + ', "title": "again"}', json.dumps(DOC | {"text": 3}), "nonsense"])
def test_bad_documents(line):
    with pytest.raises(ValueError):
        documents.parse_document(line)


def test_repeated_ids(spark, tmp_path):
    with pytest.raises(ValueError, match="twice"):
        documents.documents(spark, put(tmp_path, "d.jsonl", "\n".join([json.dumps(DOC)] * 2)))


def test_search_dump(spark, tmp_path):
    page = {"namespace": 0, "page_id": 5, "title": "A", "opening_text": "lead " * 30, "text": "One. " * 5000, "incoming_links": 400, "redirect": [{"namespace": 0, "title": "B"}, {"namespace": 1, "title": "C"}]}
    lines = [{"index": {}}, page, page | {"namespace": 4}, page | {"opening_text": "short"}, page | {"template": ["Disambiguation page"]}, page | {"incoming_links": 3, "title": "D"}]
    got = {r["title"]: r for r in documents.search_dump(spark, put(tmp_path, "x.json", "\n".join(map(json.dumps, lines)))).collect()}
    assert set(got) == {"A", "D"} and got["A"]["aliases"] == ["B"] and len(got["A"]["body"]) <= 16_000 and got["A"]["body"].endswith(".") and got["D"]["body"] == ""


def test_text_files(spark, tmp_path):
    path = put(tmp_path, "w.txt", '<doc id="1" url="u" title="A">\nA text\n</doc>\n<doc id="2" url="u" title="B">\nB\n</doc>\n')
    assert [tuple(r) for r in documents.fragments(spark, path).orderBy("id").collect()] == [("1", "A", "A text"), ("2", "B", "B")]
    path = put(tmp_path, "m.md", "---\ntitle: T\nlicense: CC0\n---\nlead\n# A\nx\n```\n# no\n```\n## B\ny\n")
    assert [(r["title"], r["license"], r["heading"], r["text"]) for r in documents.markdown(spark, path).collect()] == [("T", "CC0", "", "lead"), ("T", "CC0", "A", "x\n```\n# no\n```"), ("T", "CC0", "A > B", "y")]
    path = put(tmp_path, "q.txt", "intro\nQ: one?\nyes\nno\nQ: two?\nmaybe\n")
    assert [tuple(r) for r in documents.answers(spark, path).collect()] == [("one?", "yes\nno"), ("two?", "maybe")]
    path = put(tmp_path, "v.tsv", "a\t1,2.5\nb\t0,-1\n")
    assert [(r["id"], r["embedding"]) for r in documents.vectors(spark, path).collect()] == [("a", [1.0, 2.5]), ("b", [0.0, -1.0])]
    path = put(tmp_path, "l.txt", "Place: A\nHours: 9: to 5\nPlace: again\n\nPlace: B\n")
    assert [(r["title"], r["fields"].get("Hours")) for r in documents.listings(spark, path).collect()] == [("A", "9: to 5"), ("B", None)]


def test_wiki(spark, tmp_path):
    text = "'''Bold''' [[Link|shown]] {{see|name=Museum {{x|y}}|address=Main [[St|Street]]|lat=1.5|hours=9-5}} {{eat|name=}}<ref>r</ref>\n== Get in ==\n* by [http://x train]\n[[File:a.jpg|thumb|[[b]]]]"
    xml = f"<mediawiki><page><title>Town</title><ns>0</ns><id>7</id><revision><id>1</id><text>{text.replace('<', '&lt;')}</text></revision></page><page><title>R</title><ns>0</ns><id>8</id><redirect title='Town'/><revision><id>2</id><text>x</text></revision></page></mediawiki>"
    pages = wiki.pages(spark, put(tmp_path, "p.xml", xml))
    assert [(r["page_id"], r["title"]) for r in pages.where("page_id = 7").collect()] == [(7, "Town")]
    assert [tuple(r) for r in wiki.listings(pages.where("page_id = 7")).collect()] == [("Town", "Museum", "Destination: Town\nCategory: see\nPlace: Museum\nAddress: Main Street\nHours in source: 9-5\nLatitude: 1.5")]
    assert [tuple(r) for r in wiki.guides(pages.where("page_id = 7")).collect()] == [("Town", "", "Bold shown"), ("Town", "Get in", "- by train")]


def test_places(spark, tmp_path):
    node = {"type": "node", "id": 1, "lat": 1.0, "lon": 2.0, "tags": {"name": "Café", "amenity": "cafe", "cuisine": "a;b", "addr:street": "S", "addr:housenumber": "1", "population": "1 200"}}
    tile = {"elements": [node, node | {"type": "way", "id": 2, "lat": None, "lon": None, "center": {"lat": 1.0, "lon": 2.0}}, {"type": "node", "id": 3, "lat": 0.0, "lon": 0.0, "tags": {"amenity": "x"}}]}
    for n in ("a", "b"):
        put(tmp_path, f"{n}.json", json.dumps(tile, indent=1))
    found = places.elements(spark, f"{tmp_path}/*.json")
    assert found.count() == 3
    got = places.place_documents(places.distinct(found)).collect()
    assert [(r["id"], r["text"]) for r in got] == [("node-1", "Place: Café\nCategory: cafe\nCuisine: a, b\nAddress: S 1\nLatitude: 1.000000\nLongitude: 2.000000")]
    from pyspark.sql import functions as F

    assert [r[0] for r in spark.createDataFrame([("1 200",), ("12,5k",), (None,)], "p string").select(places.population(F.col("p"))).collect()] == [1200, None, None]


def test_packs(spark, tmp_path):
    chunks = spark.createDataFrame([(f"d:{i}", "d", "t", "s", f"text {i}") for i in range(5)], "chunk_id string, document_id string, title string, source string, text string")
    path = f"file://{tmp_path}/pack"
    manifest = packs.write_pack(chunks, path, "p", "1.0", "CC0")
    assert manifest["chunks"] == 5 and packs.read_pack(spark, path).where("pack = 'p'").count() == 5
    with pytest.raises(ValueError):
        packs.write_pack(chunks.unionByName(chunks), f"{path}2", "p", "1.0", "CC0")
    chunks.limit(4).write.mode("overwrite").parquet(f"{path}/chunks")
    with pytest.raises(ValueError):
        packs.read_pack(spark, path)
    vectors = chunks.select("chunk_id").limit(4)
    with pytest.raises(ValueError, match="missing"):
        packs.write_vectors(vectors, chunks, f"{path}/v")
    packs.write_vectors(chunks.select("chunk_id"), chunks, f"{path}/v")


def test_ingest(spark, tmp_path):
    docs = spark.createDataFrame([(i, "word " * 300) for i in range(4)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/in/a")
    run = lambda: ingest.ingest(ingest.documents(spark, f"{tmp_path}/in/*", docs.schema), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    run()
    first = spark.read.parquet(f"{tmp_path}/out").count()
    run()
    assert spark.read.parquet(f"{tmp_path}/out").count() == first == 8
    docs.unionByName(spark.createDataFrame([(9, "new")], docs.schema)).write.parquet(f"{tmp_path}/in/b")
    run()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 9


def test_lookups(spark):
    p = spark.createDataFrame([(1, "2010 Quake", "the quake hit town"), (2, "2010 Quake aftermath", "the quake hit town"), (3, "2011 Quake", "quake")], "doc_id long, title string, text string")
    assert [r["doc_id"] for r in lookup.event_leads(p, "2010", "quake", ["quake", "town"], 5).collect()] == [1]
    lines = spark.createDataFrame([("good morning", "x"), ("good day to you", "y"), ("morning", "z")], "phrase string, translation string")
    assert [r["translation"] for r in lookup.phrases(lines, ["good", "hello"], {"hello": "morning"}).collect()] == ["x"]
    s = spark.createDataFrame([(1, "cats"), (1, "dogs")], "question long, subject string")
    e = spark.createDataFrame([(1, "All about Cats.")], "question long, text string")
    assert [r["subject"] for r in lookup.uncovered(s, e, "subject", "text").collect()] == ["dogs"]
    from pyspark.sql import functions as F

    t = spark.createDataFrame([("EIP-20 sets FOO to 0x1f", "The sources don't say."), ("EIP-200 FOO 0x1f", "It is 5.")], "a string, b string")
    assert [tuple(r) for r in t.select(relevance.technical_rule(F.col("a"), "EIP-20", "FOO", "0x1f"), relevance.refusal(F.col("b"))).collect()] == [(True, True), (False, False)]


def test_attachments(spark, tmp_path):
    import zipfile

    from siltstone.sources import attachments

    word = '<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>Hello</w:t></w:r><w:r><w:t> you</w:t></w:r></w:p><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", word)
    (tmp_path / "b.txt").write_bytes("été".encode("cp1252"))
    (tmp_path / "c.xml").write_text('<!DOCTYPE x [<!ENTITY a "b">]><x>&a;</x>')
    (tmp_path / "d.docx").write_bytes(b"no archive")
    got = {r["path"][-6:]: r for r in attachments.attachments(spark, str(tmp_path)).collect()}
    assert got["a.docx"]["text"] == "Hello you\nTwo" and got["/b.txt"]["text"] == "été"
    assert got["/c.xml"]["text"] is None and got["d.docx"]["error"].startswith("BadZipFile")
    book = b"<document><title>T</title><content><para>Lead.</para><section><title>A</title><para>x <math><mn>2</mn></math></para><section><title>B</title><para>y</para></section></section></content></document>"
    assert attachments.book_sections(book) == [("", "Lead."), ("A", "x 2"), ("A > B", "y")]
    topic = b'<t><health-topic id="1" title="Flu"><also-called>Grippe</also-called><full-summary>&lt;p&gt;Rest.&lt;/p&gt;</full-summary></health-topic></t>'
    assert attachments.topics(topic) == [("1", "Flu", "Rest.", ["Grippe"])]


def test_leads(spark):
    from pyspark.sql import functions as F

    from siltstone.operators import leads

    df = spark.createDataFrame([("One is here. Two follows. Three ends.\n\nNext.",), ("no end",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(leads.lead(F.col("t"), 20, 30)).collect()] == ["One is here. Two follows.", None, None, None]
    assert df.select(leads.excerpt(F.col("t"), ["three"], 2)).first()[0] == "Two follows. Three ends."


def test_record_blocks(spark, tmp_path):
    from pyspark.sql import functions as F

    from siltstone.sources import blocks

    rows = [(i, None if i == 7 else f"é{i} " * (i % 90)) for i in range(500)] + [(1000, "x" * 9000)]
    df = spark.createDataFrame(rows, "id long, t string").repartition(6)
    path = str(tmp_path / "b")
    blocks.write(df, path, "id", "t", size=1000)
    held = spark.read.parquet(f"{path}/blocks")
    assert held.count() > 20 and held.agg({"n": "sum"}).first()[0] == 501
    asked = spark.createDataFrame([(3,), (3,), (7,), (1000,), (5555,), (None,)], "id long")
    assert {r["id"]: r["record"] for r in blocks.lookup(spark, path, asked, "id").collect()} == {3: "é3 " * 3, 7: "", 1000: "x" * 9000}
    assert tuple(blocks.compared(spark, path, df, "id", "t").first()) == (501, 0, 0, 0)
    other = df.where("id != 3").unionByName(spark.createDataFrame([(2000, "new")], "id long, t string")).withColumn("t", F.when(F.col("id") == 5, "changed").otherwise(F.col("t")))
    assert tuple(blocks.compared(spark, path, other, "id", "t").first()) == (501, 1, 1, 1)
    with pytest.raises(ValueError, match="names 2 records"):
        blocks.write(df.unionByName(df.where("id = 4")), str(tmp_path / "c"), "id", "t")
