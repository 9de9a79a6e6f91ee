"""Queries on scans, one-to-one joins and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions.labels import heading_parts, heading_path, page_ranges, within_edits
from siltstone.operators import scans
from siltstone.plans.base import registry
from siltstone.sources.tables import table

QUERIES, ORACLES, query = registry()


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 1000 AND o_orderkey < 3000")
def key_range_scan(spark, sf):
    return scans.key_range(table(spark, sf, "orders"), "o_orderkey", 1000, 3000).select("o_orderkey", "o_custkey")


@query("SELECT source, min(doc_id) AS first, max(doc_id) AS last FROM documents GROUP BY 1")
def ends_probe(spark, sf):
    return scans.ends(table(spark, sf, "documents"), "source", "doc_id")


@query("SELECT c_nationkey, least(count(*) FILTER (c_acctbal < 0), 40) AS found FROM customer GROUP BY 1")
def exists_probe(spark, sf):
    return scans.exists(table(spark, sf, "customer"), F.col("c_acctbal") < 0, "c_nationkey")


@query("SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM documents GROUP BY 1 HAVING count(*) % 2 = 0)")
def enabled_collections(spark, sf):
    docs = table(spark, sf, "documents")
    on = docs.groupBy("source").count().where("count % 2 = 0")
    return scans.enabled(docs, on, "source").select("doc_id", "source")


@query("""SELECT 'missing' AS problem, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'extra', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'repeated', count(*) FROM (SELECT doc_id FROM labels GROUP BY 1 HAVING count(*) > 1)""")
def answers_one_to_one(spark, sf):
    return scans.one_to_one(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query("SELECT n_nationkey, n_name AS article, r_name AS section FROM nation JOIN region ON n_regionkey = r_regionkey")
def heading_split(spark, sf):
    both = table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.select("n_nationkey", heading_parts(F.concat_ws(" — ", "n_name", "r_name")).alias("h")).select("n_nationkey", "h.article", "h.section")


@query("""SELECT k AS o_custkey, string_agg(CASE WHEN a = z THEN a::VARCHAR ELSE a || '–' || z END, ', ' ORDER BY a) AS pages FROM (SELECT k, min(p) AS a, max(p) AS z FROM
(SELECT k, p, p - row_number() OVER (PARTITION BY k ORDER BY p) AS run FROM (SELECT DISTINCT o_custkey AS k, o_orderkey % 30 AS p FROM orders)) GROUP BY k, run) GROUP BY k""")
def page_range_labels(spark, sf):
    pages = table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_set(F.col("o_orderkey") % 30).alias("p"))
    return pages.select("o_custkey", page_ranges(F.col("p")).alias("pages"))


@query("SELECT n_nationkey, r_regionkey, least(levenshtein(n_name, r_name), 5)::INT AS edits FROM nation JOIN region ON n_regionkey = r_regionkey")
def capped_edits(spark, sf):
    both = table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.select("n_nationkey", "r_regionkey", within_edits(F.col("n_name"), F.col("r_name"), 4).alias("edits"))


@query("""SELECT c_custkey, 'Customer ' || c_custkey AS article, CASE c_custkey % 4 WHEN 1 THEN '' WHEN 2 THEN c_mktsegment WHEN 3 THEN c_mktsegment || '|N' || c_nationkey ELSE '' END AS above, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN c_mktsegment ELSE 'N' || (c_nationkey + CASE c_custkey % 4 WHEN 3 THEN 1 ELSE 0 END) END AS own FROM customer""")
def heading_paths(spark, sf):
    """Titles with none to three headings after the article."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    title = F.concat(F.lit("Customer "), k, F.when(k % 4 == 0, "").when(k % 4 == 1, F.concat(F.lit(" — "), "c_mktsegment")).when(k % 4 == 2, F.concat(F.lit(" — "), "c_mktsegment", F.lit(" > N"), n)).otherwise(F.concat(F.lit(" — "), "c_mktsegment", F.lit(" > N"), n, F.lit(" > N"), n + 1)))
    return table(spark, sf, "customer").select("c_custkey", heading_path(title).alias("h")).select("c_custkey", "h.article", F.array_join("h.above", "|").alias("above"), "h.own")
