"""Queries on relevance and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import relevance
from siltstone.operators import lookup, search
from siltstone.plans.base import registry
from siltstone.sources.tables import table

QUERIES, ORACLES, query = registry()
_W = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
_TITLED = "(SELECT doc_id, source, array_to_string(list_slice(string_split(string_split(text, chr(10))[1], ' '), 1, 6), ' ') AS title, text FROM documents)"
_HITS = " + ".join([f"(len(list_filter({_W}, lambda w: starts_with(w, '{t}'))) > 0)::INT" for t in ("thing", "tion", "that")] + [f"list_contains({_W}, 'the')::INT"])


@query(f"SELECT doc_id, {_HITS} AS hits FROM documents WHERE {_HITS} >= 2")
def relevance_gate(spark, sf):
    terms = ("thing", "tion", "that", "the")
    docs = table(spark, sf, "documents").where(relevance.relevant(F.col("text"), terms))
    return docs.select("doc_id", relevance.hits(F.col("text"), terms).alias("hits"))


@query(r"SELECT doc_id FROM documents WHERE NOT regexp_matches(text, '[.!?:]') OR regexp_matches(lower(trim(text)), '^(contents|table of contents|navigation)\b') OR (len(regexp_split_to_array(text, '[|•·»]')) - 1) * 12 > length(text)")
def boilerplate_passages(spark, sf):
    return table(spark, sf, "documents").where(relevance.boilerplate(F.col("text"))).select("doc_id")


@query(r"""SELECT doc_id, (coalesce(list_sum(list_transform(regexp_extract_all(text, '\p{L}+'), lambda x: ceil(length(x) / 4.0))), 0) + coalesce(list_sum(list_transform(regexp_extract_all(text, '\p{N}+'), lambda x: ceil(length(x) / 3.0))), 0) + len(regexp_extract_all(text, '[^\p{L}\p{N}\s]')))::INT AS tokens FROM documents""")
def token_estimates(spark, sf):
    return table(spark, sf, "documents").select("doc_id", relevance.token_estimate(F.col("text")).alias("tokens"))


@query(rf"SELECT doc_id, title FROM {_TITLED} WHERE contains(' ' || array_to_string(regexp_extract_all(lower(title), '[\p{{L}}\p{{N}}]+'), ' ') || ' ', ' of the ') ORDER BY length(title), doc_id LIMIT 25")
def titled_phrase(spark, sf):
    return lookup.titled(search.passages(table(spark, sf, "documents")), "of the", 25).select("doc_id", "title")


@query(r"SELECT doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(text, '\d+(?:,\d{3})*(?:\.\d+)?'), lambda x: replace(x, ',', ''))))::VARCHAR AS figures FROM documents WHERE regexp_matches(text, '\d')")
def figures_of_texts(spark, sf):
    docs = table(spark, sf, "documents").where(F.col("text").rlike(r"\d"))
    return docs.select("doc_id", F.concat(F.lit("["), F.array_join(F.array_sort(relevance.figures(F.col("text"))), ", "), F.lit("]")).alias("figures"))


@query("SELECT o_orderkey, abs(o_totalprice - o_custkey * 100) <= (CASE WHEN o_orderkey % 2 = 0 THEN 0.10 ELSE 0.02 END) * abs(o_custkey * 100) AS agrees FROM orders")
def quantities_agree(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", relevance.agrees(F.col("o_totalprice"), F.col("o_custkey") * 100, F.col("o_orderkey") % 2 == 0).alias("agrees"))


@query("SELECT o_orderkey, o_orderkey % 5 >= 3 AND o_custkey % 3 > 0 AS asks FROM orders")
def word_problems(spark, sf):
    """Questions with none to four counted numbers, two of three of which ask for arithmetic."""
    counted = F.expr("repeat('12 boxes and ', cast(o_orderkey % 5 as int))")
    ends = F.element_at(F.array(*map(F.lit, ("so they say.", "HOW MANY are left?", "what is the total"))), (F.col("o_custkey") % 3 + 1).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", relevance.word_problem(F.concat(F.lit("Take "), counted, ends)).alias("asks"))


@query("SELECT l_orderkey AS q, l_linenumber AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_linenumber WHEN l_orderkey % 7 + 1 THEN 0 WHEN l_orderkey % 5 + 1 THEN 1 ELSE 2 END, l_linenumber) AS place FROM lineitem")
def cited_sources_first(spark, sf):
    """Lines of an order as the sources of an answer that cites two of them, the first of them again at the end."""
    first, second = ((F.col("l_orderkey") % m + 1).cast("string") for m in (7, 5))
    answer = F.concat(F.lit("See ["), first, F.lit("], then ["), second, F.lit("], and ["), first, F.lit("]."))
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("q"), F.col("l_linenumber").alias("n"), answer.alias("answer"))
    found = lookup.cited_first(rows, "answer", "q")
    return found.select("q", "n", F.col("place").cast("long").alias("place"))


@query("SELECT c_custkey // 3 AS record, CASE WHEN count(DISTINCT c_mktsegment) = 1 AND count(*) < 20 THEN min(c_mktsegment) END AS value FROM customer GROUP BY 1")
def unanimous_field(spark, sf):
    rows = table(spark, sf, "customer").select(F.expr("c_custkey div 3").alias("record"), F.col("c_mktsegment").alias("value"))
    return lookup.unanimous(rows, "record", "value")


@query("""WITH a AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders), b AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rank FROM orders),
u AS (SELECT id, 0 AS tier, rank FROM a WHERE rank <= 3 UNION ALL SELECT id, 1, rank FROM b WHERE rank <= 40)
SELECT id, row_number() OVER (ORDER BY min(tier), min(rank), id) AS rank FROM u GROUP BY id""")
def evidence_carried_over(spark, sf):
    from pyspark.sql import Window as W

    o = table(spark, sf, "orders")
    a = o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(3).select(F.col("o_orderkey").alias("id"), F.row_number().over(W.orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("rank"))
    b = o.orderBy("o_totalprice", "o_orderkey").limit(40).select(F.col("o_orderkey").alias("id"), F.row_number().over(W.orderBy("o_totalprice", "o_orderkey")).alias("rank"))
    return lookup.carried(a, b, "id").select("id", F.col("rank").cast("long").alias("rank"))


@query(r"""SELECT doc_id, sentence, hits FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, n) AS r FROM (SELECT doc_id, n, s[n] AS sentence, list_contains(regexp_extract_all(lower(s[n]), '[\p{L}\p{N}]+'), 'the')::INT + list_contains(regexp_extract_all(lower(s[n]), '[\p{L}\p{N}]+'), 'of')::INT AS hits
FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS n FROM (SELECT doc_id, list_filter(string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: length(x) > 0) AS s FROM documents))) WHERE hits > 0) WHERE r = 1""")
def best_sentences(spark, sf):
    from siltstone.operators.leads import best_sentence

    return best_sentence(table(spark, sf, "documents"), "doc_id", "text", ("the", "of"))


@query()
def definition_leads(spark, sf):
    from siltstone.operators.leads import lead

    return table(spark, sf, "documents").select("doc_id", lead(F.col("text")).alias("lead"))
