"""Queries on collections: what enters one of a given size, and tables of pages."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from siltstone.functions.text import query_terms
from siltstone.operators import emergency, listings, merge, running, selection
from siltstone.plans.base import registry
from siltstone.sources import blocks
from siltstone.sources.html import table_rows
from siltstone.sources.tables import dealt, shared_folder, table

QUERIES, ORACLES, query = registry()

_NAMED = "array_to_string(list_slice(string_split(string_split(text, chr(10))[1], ' '), 1, 2), ' ')"


def _titled(spark, sf):
    first = F.array_join(F.slice(F.split(F.get(F.split("text", "\n"), F.lit(0)), " "), 1, 2), " ")
    title = F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("List of "), first)).when(F.col("doc_id") % 13 == 0, F.concat(first, F.lit(" (1999 film)"))).otherwise(first)
    return table(spark, sf, "documents").select("doc_id", title.alias("title"), "text")


_CHOSEN = f"""docs AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'List of ' || {_NAMED} WHEN doc_id % 13 = 0 THEN {_NAMED} || ' (1999 film)' ELSE {_NAMED} END AS title, length(text) AS size FROM documents),
wanted AS (SELECT DISTINCT lower(trim(replace(title, '_', ' '))) AS t FROM docs WHERE doc_id % 97 = 0),
marked AS (SELECT *, lower(trim(replace(title, '_', ' '))) IN (SELECT t FROM wanted) AS vital FROM docs),
rest AS (SELECT doc_id, size, (SELECT coalesce(sum(size), 0) FROM marked WHERE vital) + coalesce(sum(size) OVER (ORDER BY size DESC, doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM marked
 WHERE NOT vital AND size BETWEEN 800 AND 60000 AND NOT regexp_matches(title, '(?i)\\(1999 film\\)$') AND NOT (starts_with(title, 'List of ') AND size < 2500))"""


@query(f"WITH {_CHOSEN} SELECT doc_id, size, true AS vital, NULL::BIGINT AS before FROM marked WHERE vital UNION ALL SELECT doc_id, size, false, before::BIGINT FROM rest WHERE before < 2000000")
def corpus_within_budget(spark, sf):
    """Documents of wanted titles, and the longest of the others, up to two million characters."""
    docs = _titled(spark, sf)
    return selection.within_budget(docs, docs.where("doc_id % 97 = 0").select("title"), 2_000_000)


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place, round(coalesce(sum(floor(o_totalprice)) OVER (ORDER BY o_totalprice DESC, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS before FROM orders")
def running_order_totals(spark, sf):
    """Each order's place by price over the whole table, and what the orders before it come to."""
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.floor("o_totalprice").cast("long").alias("whole"))
    order = [F.desc("o_totalprice"), F.col("o_orderkey")]
    return running.summed(running.numbered(rows, order, "place"), order, "whole", "before").select("o_orderkey", "place", F.col("before").cast("long").alias("before"))


def _pages(spark, sf):
    """A page for each customer, with a table of three countries: one with a cell across all services, one with a number for each and notes, one that stands over two rows."""
    k = F.col("c_custkey").cast("string")
    html = F.concat_ws(
        "", F.lit("<h2>Region&nbsp;"), F.col("c_nationkey"), F.lit("</h2><table class='wikitable x'><tr><th>Country</th><th>Police</th><th>Ambulance<sup class='reference'>[1]</sup></th><th>Fire</th><th>Notes</th></tr><tr><td>A"), k, F.lit("</td><td colspan=3>1"), k,
        F.lit(" or 112</td><td>Emergency – 9"), k, F.lit("; Non-emergency police – 101</td></tr><tr><td>B"), k, F.lit("</td><td>"), k, F.lit("</td><td>call "), k, F.lit("</td><td>(+4) "), k, F.lit("-1/7</td><td>Fire brigade – 5"), k, F.lit(", Police – "), k, F.lit(" or 8</td></tr><tr><td rowspan='2'>C"), k,
        F.lit("</td><td>3<br>"), k, F.lit("</td><td></td><td>2</td></tr><tr><td>3 "), k, F.lit("</td><td></td><td>2</td></tr></table><table><tr><td>other</td></tr></table>"),
    )
    return dealt(table(spark, sf, "customer").select("c_custkey", "c_nationkey")).select(F.col("c_custkey").alias("page_id"), html.alias("html"))


@query("""WITH c AS (SELECT c_custkey AS i, c_custkey::VARCHAR AS k, 'Region ' || c_nationkey AS region FROM customer), none AS (SELECT []::VARCHAR[] AS e)
SELECT 'a' || k AS code, 'A' || k AS name, region, '1' || k || ' 112' AS police, '1' || k || ' 112' AS ambulance, '1' || k || ' 112' AS fire, '1' || k || ' 112 9' || k AS general, '' AS unread FROM c WHERE k <> '12'
UNION ALL SELECT 'b' || k, 'B' || k, region, CASE WHEN k = '8' THEN '8' ELSE k || ' 8' END, '', '(+4) ' || k || '-1 7 5' || k, '', 'ambulance' FROM c
UNION ALL SELECT 'c' || k, 'C' || k, region, '3 ' || k, '', '2', '', '' FROM c""")
def emergency_numbers(spark, sf):
    """Numbers of the countries in each page's table."""
    pages = _pages(spark, sf)
    names = table(spark, sf, "customer").select(F.explode(F.array(*(F.struct(F.concat(F.lit(c), "c_custkey").alias("name"), F.concat(F.lit(c.lower()), "c_custkey").alias("code")) for c in "ABC"))).alias("x")).select("x.*").where("code <> 'a12'")
    found = emergency.numbers(table_rows(pages), names)
    return found.select("code", "name", "region", *(F.array_join(c, " ").alias(c) for c in ("police", "ambulance", "fire", "general", "unread")))


def _blocks(spark, sf):
    """Where documents have been written in blocks; the folder goes when the application ends."""
    path = f"{shared_folder(spark)}/siltstone-blocks-{uuid.uuid4().hex}"
    blocks.write(table(spark, sf, "documents").select("doc_id", "text"), path, "doc_id", "text")
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


@query("SELECT doc_id, md5(text) AS digest FROM documents WHERE doc_id % 20 = 0")
def records_by_key(spark, sf):
    """Every twentieth document, looked up by id in compressed blocks."""
    asked = table(spark, sf, "documents").where("doc_id % 20 = 0").select("doc_id")
    return blocks.lookup(spark, _blocks(spark, sf), asked, "doc_id").select("doc_id", F.md5("record").alias("digest"))


@query("SELECT count(*) AS records, 0::BIGINT AS missing, 0::BIGINT AS extra, 0::BIGINT AS different FROM documents")
def blocks_compared(spark, sf):
    """Blocks of documents held against the documents, record by record."""
    return blocks.compared(spark, _blocks(spark, sf), table(spark, sf, "documents"), "doc_id", "text")


def _places(spark, sf):
    """A listing for each customer, with a question about it."""
    k = F.col("c_custkey")
    town = F.concat(F.lit("Town"), k % 9)
    text = F.concat_ws("\n", F.concat(F.lit("Destination: "), town), F.concat(F.lit("Place: Casa"), k % 5, F.lit(" Bar")), F.concat(F.lit("Category: "), F.col("c_mktsegment")), F.when(k % 4 > 0, F.concat(F.lit("Description: near gate"), k % 11)))
    question = F.concat(F.lit("Suggest a place near gate"), k % 3, F.lit(" in Town"), k % 9, F.when(k % 2 == 0, F.concat(F.lit(", not Casa"), k % 7)).otherwise(", no matter Which"))
    return table(spark, sf, "customer").select(k.alias("id"), text.alias("text"), F.when(k % 6 == 0, F.lower("c_mktsegment")).alias("category"), question.alias("question"), F.concat(F.lit("Casa"), k % 5, F.lit(" Bar")).alias("name"), (k % 100 / 100).alias("score"))


@query("SELECT c_custkey AS id FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_custkey % 100 >= 68")
def listings_of_categories(spark, sf):
    """Places of two categories, by column or by the text's line, that are similar enough."""
    return listings.above(listings.of_categories(_places(spark, sf), ["building", "Machinery"], "category")).select("id")


@query("SELECT c_custkey AS id, c_custkey % 4 > 0 AND starts_with('gate' || c_custkey % 11, 'gate' || c_custkey % 3) AS fits FROM customer WHERE NOT (c_custkey % 2 = 0 AND c_custkey % 7 = c_custkey % 5)")
def listings_that_fit(spark, sf):
    """Places that their question doesn't rule out, and whether their lines say what it asks for."""
    rows = listings.kept(_places(spark, sf).withColumn("question", F.translate("question", "0123456789", "abcdefghij")).withColumn("name", F.translate("name", "0123456789", "abcdefghij")))
    terms = F.filter(query_terms(F.regexp_replace("question", r" in Town.*$", "")), lambda t: t.startswith("gate"))
    return rows.select("id", listings.fits(F.translate("text", "0123456789", "abcdefghij"), terms).alias("fits"))


@query("SELECT o_custkey AS q, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY place, pack) AS turn FROM (SELECT *, o_orderkey % 3 AS pack, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 3 ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders)")
def files_take_turns(spark, sf):
    """Each customer's orders dealt to three files: the best of every file, then the second of every one."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("q"), F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 3).alias("pack"), F.col("o_totalprice").alias("score"))
    return merge.round_robin(o, key="id", by=["q"]).select("q", "id", F.col("turn").cast("long").alias("turn"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 0 THEN 'missing' WHEN o_orderkey % 10 = 1 THEN 'repeated' WHEN o_orderkey % 10 IN (2, 3) THEN 'no metadata' END AS problem FROM orders WHERE o_orderkey % 10 < 4 UNION ALL SELECT -c_custkey - 1, 'extra' FROM customer""")
def provenance_problems(spark, sf):
    """Orders as documents whose provenance lacks rows, repeats some, and holds what is no object."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    meta = F.when(F.col("id") % 10 == 2, "[1]").when(F.col("id") % 10 == 3, '{"a": ').otherwise('{"license": "x"}')
    own = o.where("id % 10 != 0").withColumn("metadata", meta)
    more = table(spark, sf, "customer").select((-F.col("c_custkey") - 1).alias("id"), F.lit("{}").alias("metadata"))
    return listings.uncovered(o, own.unionByName(own.where("id % 10 = 1")).unionByName(more), "id")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name || ' is good. It ends' WHEN 1 THEN p_name || ' is red. Last one.' WHEN 2 THEN 'Kept. Too.' ELSE 'No errors here:  two  spaces' END AS text FROM part""")
def script_errors_removed(spark, sf):
    """Texts with errors of packages, at the beginning, within a sentence, and without any."""
    error = "Lua error in Module:X at line 88: attempt to call field 'y' (a nil value)."
    forms = (
        F.concat(F.lit("Lua error in package.lua at line 80: module 'Module:P' not found. "), "p_name", F.lit(" is good. It ends")), F.concat(F.lit(f"{error} is red. Last one.")), F.lit(f"Kept. Gone {error} with it. Too."), F.lit("No errors here:  two  spaces"),
    )
    text = F.get(F.array(*forms), (F.col("p_partkey") % 4).cast("int"))
    return table(spark, sf, "part").select("p_partkey", listings.without_script_errors(text, F.col("p_name")).alias("text"))
