"""Queries on semi-structured records: JSON, listings, conversations, catalogues."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions.text import destinations, field
from siltstone.operators import editions, history
from siltstone.plans.base import registry
from siltstone.sources.tables import table

QUERIES, ORACLES, query = registry()


@query("SELECT event_id, event_type, json_extract_string(props, '$.k') AS k, length(props) AS n FROM events")
def props_projection(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", "event_type", F.get_json_object("props", "$.k").alias("k"), F.length("props").cast("long").alias("n"))


_LISTING = "'Place: ' || c_name || chr(10) || 'Type: ' || c_mktsegment || chr(10) || 'Hours: 9: to 5' || chr(10) || 'Balance: ' || round(c_acctbal, 0)::BIGINT"


@query("SELECT c_custkey AS id, c_name AS place, c_mktsegment AS kind, '9: to 5' AS hours, NULL::VARCHAR AS phone FROM customer")
def listing_fields(spark, sf):
    text = F.concat_ws("\n", F.concat(F.lit("Place: "), "c_name"), F.concat(F.lit("Type: "), "c_mktsegment"), F.lit("Hours: 9: to 5"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), text.alias("t")).select("id", field(F.col("t"), "Place").alias("place"), field(F.col("t"), "Type").alias("kind"), field(F.col("t"), "Hours").alias("hours"), field(F.col("t"), "Phone").alias("phone"))


@query("SELECT n_name, lower(r_name) || ',' || lower(r_name) || '/' || lower(n_name) AS places FROM nation JOIN region ON n_regionkey = r_regionkey")
def destination_hierarchy(spark, sf):
    joined = table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    title = F.concat("r_name", F.lit("/"), "n_name", F.lit(" — Overview"))
    return joined.select("n_name", F.array_join(destinations(title), ",").alias("places"))


@query("SELECT p_partkey // 2 AS record, CASE WHEN count(DISTINCT p_brand) = 1 THEN min(p_brand) END AS value FROM part GROUP BY 1")
def field_lookup(spark, sf):
    """A field's value where all records of a name agree, else null."""
    return table(spark, sf, "part").groupBy(F.expr("p_partkey div 2").alias("record")).agg(F.when(F.countDistinct("p_brand") == 1, F.min("p_brand")).alias("value"))


@query("SELECT coalesce(CASE WHEN conv_id % 5 != 0 THEN (conv_id % 50)::VARCHAR END, '@' || (conv_id * 1000 + turn)) AS topic, count(*) AS turns, min(conv_id * 1000 + turn) AS first, max(conv_id * 1000 + turn) AS latest FROM conversations GROUP BY 1")
def history_topics(spark, sf):
    c = table(spark, sf, "conversations").select(F.when(F.col("conv_id") % 5 != 0, F.col("conv_id") % 50).alias("topic"), (F.col("conv_id") * 1000 + F.col("turn")).alias("at"))
    return history.topics(c, "topic", "at")


@query("SELECT conv_id, turn, md5(text) AS digest FROM conversations WHERE contains(lower(text), 'the') AND contains(lower(text), 'of')")
def history_search(spark, sf):
    return history.search(table(spark, sf, "conversations"), "text", ["the", "Of"]).select("conv_id", "turn", F.md5("text").alias("digest"))


@query("SELECT conv_id, run, count(*) AS n FROM (SELECT conv_id, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS run FROM conversations) GROUP BY ALL")
def session_lines(spark, sf):
    c = history.runs(table(spark, sf, "conversations"), "conv_id", "turn", F.col("role") == "user")
    return c.groupBy("conv_id", "run").agg(F.count("*").alias("n"))


@query(r"SELECT conv_id, turn, CASE WHEN len(regexp_split_to_array(trim(text), '\s+')) <= 6 THEN md5(lag(text) OVER (PARTITION BY conv_id ORDER BY turn)) END AS context FROM conversations")
def follow_up_context(spark, sf):
    return history.follow_ups(table(spark, sf, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", F.md5("context").alias("context"))


@query("""WITH e AS (SELECT p_partkey, p_size AS m, p_partkey % 50 + 1 AS n, ['', '-preview', '-rebuild', '-a'][p_partkey % 4 + 1] AS s, ['', '-preview', '-rebuild', '-a'][p_partkey // 4 % 4 + 1] AS t FROM part),
r AS (SELECT *, CASE s WHEN '-preview' THEN 0 WHEN '' THEN 1 ELSE 2 END AS x, CASE t WHEN '-preview' THEN 0 WHEN '' THEN 1 ELSE 2 END AS y FROM e)
SELECT p_partkey, CASE WHEN p_partkey % 17 = 0 THEN NULL WHEN m <> n THEN sign(m - n) WHEN s = t THEN 0 WHEN x <> y THEN sign(x - y) END::INT AS c FROM r""")
def edition_compare(spark, sf):
    """Editions of two and three numbers with and without suffixes, some without a number."""
    k, ends = F.col("p_partkey"), F.array(*map(F.lit, ("", "-preview", "-rebuild", "-a")))
    left = F.concat(F.when(k % 17 == 0, "x").otherwise("2026."), F.col("p_size"), F.lit(".0"), F.get(ends, (k % 4).cast("int")))
    right = F.concat(F.lit("2026."), k % 50 + 1, F.get(ends, F.expr("cast(p_partkey div 4 % 4 as int)")))
    return table(spark, sf, "part").select("p_partkey", editions.compare(left, right).alias("c"))


@query("""SELECT p_brand AS id, '2.' || max(p_size) AS version, CASE WHEN count(*) FILTER (p_partkey % 3 = 0) = 0 THEN 'new' ELSE 'update' END AS offer FROM part GROUP BY p_brand
HAVING count(*) FILTER (p_partkey % 3 = 0) = 0 OR max(p_size) > max(p_size) FILTER (p_partkey % 3 = 0)""")
def catalog_offers(spark, sf):
    part = table(spark, sf, "part")
    catalogue = part.groupBy(F.col("p_brand").alias("id")).agg(F.concat(F.lit("2."), F.max("p_size").cast("string")).alias("version"))
    installed = part.where("p_partkey % 3 = 0").select(F.col("p_brand").alias("id"), F.concat(F.lit("2."), F.col("p_size").cast("string")).alias("version"))
    return editions.offers(catalogue, installed)


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'a') AND contains(lower(p_name), 're')")
def catalog_search(spark, sf):
    return history.search(table(spark, sf, "part"), "p_name", ["a", "re"]).select("p_partkey", "p_name")
