"""The stored index against the unindexed search, and its query language against plain Python."""

from __future__ import annotations

import re

import pytest

from siltstone.operators import inverted, search

ROWS = [(1, "Red fox", "The red fox runs. The fox!"), (2, "Blue", "a red bird, blue sky"), (3, "Foxes", "foxes and the bird"), (4, "", ""), (5, None, None), (6, "Sky", "sky " * 300 + "red fox"), (7, "The end", "fox red")]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    docs = spark.createDataFrame(ROWS, "doc_id long, title string, text string")
    path = str(tmp_path_factory.mktemp("index"))
    inverted.write(docs, path, fields=("title", "text"))
    return inverted.Index(spark, path), docs


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def test_scores_equal_the_unindexed_search(index):
    ix, docs = index
    for terms in (["fox"], ["red", "fox", "red"], ["bird", "none"], ["none"], []):
        got = {r[0]: round(r[1], 9) for r in ix.bm25(terms).collect()}
        want = {r[0]: round(r[1], 9) for r in search.bm25(docs, terms).collect()} if terms else {}
        assert got == want
    assert ix.frequencies(["fox", "sky", "none"]) == {"fox": 3, "sky": 2}
    assert ix.fields == {"title": (7, 7), "text": (7, 319)}
    got = {r[0]: (r[1], round(r[2], 9)) for r in ix.pool(["red", "fox"], 2).collect()}
    assert got == {r[0]: (r[1], round(r[2], 9)) for r in search.pool(docs, ["red", "fox"], 2).collect()}


@pytest.mark.parametrize(
    ("query", "test"),
    [
        ("red fox", lambda t, w: "red" in t + w and "fox" in t + w),
        ("text:red AND text:fox OR title:blue", lambda t, w: ("red" in w and "fox" in w) or "blue" in t),
        ("text:fox* (text:bird OR text:runs)", lambda t, w: any(x.startswith("fox") for x in w) and ("bird" in w or "runs" in w)),
        ('text:"red fox"', lambda t, w: " red fox " in f" {' '.join(w)} "),
        ('text:^the OR title:"red fox"', lambda t, w: w[:1] == ["the"] or " red fox " in f" {' '.join(t)} "),
        ("title:(red OR sky)", lambda t, w: "red" in t or "sky" in t),
        ("nothing", lambda t, w: False),
        ("---", lambda t, w: False),
    ],
)
def test_query_language(index, query, test):
    ix, docs = index
    assert sorted(r[0] for r in ix.match(query, docs).collect()) == [k for k, t, w in ROWS if test(words(t), words(w))]


PLACED = {'text:"the red fox"': [1], '"red fox" OR "fox red"': [1, 6, 7], "text:^sky": [6], 'text:^"a red"': [2], "text:red-fo*": [1, 6], 'title:"the end" AND text:^fox': [7], '"fox the fox"': [], '"sky sky sky"': [6], "text:^red": []}


def test_phrases_by_place_alone(index, spark, tmp_path):
    """Without the documents; and the same of an index that was added to."""
    path = str(tmp_path / "two")
    docs = index[1]
    inverted.write(docs.where("doc_id <= 3"), path, fields=("title", "text"))
    inverted.append(docs.where("doc_id > 3"), path)
    both = inverted.Index(spark, path)
    for query, want in PLACED.items():
        assert sorted(r[0] for r in index[0].match(query).collect()) == want
        assert sorted(r[0] for r in both.match(query).collect()) == want
    assert both.fields == index[0].fields and both.frequencies(["fox", "sky"]) == index[0].frequencies(["fox", "sky"])
    scores = lambda ix: {r[0]: round(r[1], 9) for r in ix.bm25(["fox", "red"]).collect()}
    assert scores(both) == scores(index[0])
    with pytest.raises(ValueError, match="is in the index"):
        inverted.append(docs.where("doc_id = 2"), path)


@pytest.mark.parametrize("query", ["", "(red", "red)", "red OR", "where:red", "text:", '^(red)'])
def test_bad_queries(index, query):
    with pytest.raises(ValueError):
        index[0].match(query, index[1])


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    inverted.write(docs, str(tmp_path))
    ix = inverted.Index(spark, str(tmp_path))
    assert ix.bm25(["red"]).count() == 0 and ix.match("red OR fox*").count() == 0
