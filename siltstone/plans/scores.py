"""Queries on scores and calculations."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import calculators as calc
from siltstone.functions.hashing import Softmax
from siltstone.functions.text import stem
from siltstone.operators import evaluation, search
from siltstone.plans.base import registry
from siltstone.sources.tables import table

QUERIES, ORACLES, query = registry()


@query("SELECT lang AS category, count(*) AS n, round_even(avg(quality), 6) AS mean FROM labels JOIN documents USING (doc_id) GROUP BY 1 UNION ALL SELECT 'all', count(*), round_even(avg(quality), 6) FROM labels JOIN documents USING (doc_id)")
def benchmark_scores(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return evaluation.by_category(rows, "lang", "quality")


@query("SELECT lang, round_even(avg(toxic) / nullif(avg(quality), 0), 6) AS ratio FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def score_ratio(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return evaluation.ratio(rows, "lang", "toxic", "quality")


@query("""WITH r AS (SELECT l_suppkey AS q, l_partkey AS item, row_number() OVER (PARTITION BY l_suppkey ORDER BY sum(l_quantity) DESC, l_partkey) AS rank FROM lineitem GROUP BY 1, 2),
g AS (SELECT DISTINCT l_suppkey AS q, l_partkey AS item FROM lineitem WHERE l_quantity >= 48), k AS (SELECT * FROM r WHERE rank <= 20)
SELECT g.q, coalesce(bool_or(rank = 1), false) AS hit_1, coalesce(bool_or(rank <= 5), false) AS hit_5, count(*) FILTER (rank IS NULL) AS missing FROM g LEFT JOIN k USING (q, item) GROUP BY g.q""")
def hit_at_k(spark, sf):
    from pyspark.sql import Window as W

    items = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("q"), F.col("l_partkey").alias("item"), "l_quantity")
    sums = items.groupBy("q", "item").agg(F.sum("l_quantity").alias("s"))
    ranked = sums.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("s"), "item"))).where("rank <= 20")
    return evaluation.hits(ranked, items.where("l_quantity >= 48").select("q", "item").distinct(), "q", "item")


@query("""SELECT o_orderpriority AS category, count(*) AS n, round_even(avg(CASE WHEN a THEN c::INT END), 6) AS correct, round_even(avg(CASE WHEN NOT a THEN r::INT END), 6) AS gaps, round_even(avg(CASE WHEN a THEN r::INT END), 6) AS false_refusals, median(w) AS median_words
FROM (SELECT o_orderpriority, o_orderkey % 3 != 0 AS a, o_totalprice > 100000 AS c, o_custkey % 4 = 0 AS r, o_orderkey % 101 AS w FROM orders) GROUP BY 1""")
def reader_scores(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("category"), (F.col("o_orderkey") % 3 != 0).alias("answerable"), (F.col("o_totalprice") > 100000).alias("correct"), (F.col("o_custkey") % 4 == 0).alias("refused"), (F.col("o_orderkey") % 101).alias("words"))
    return evaluation.reader(o)


@query("SELECT doc_id, quality AS first, toxic AS second, toxic - quality AS change FROM labels")
def paired_runs(spark, sf):
    labels = table(spark, sf, "labels")
    first, second = (labels.select("doc_id", F.col(c).alias("score")) for c in ("quality", "toxic"))
    return evaluation.paired(first, second, ["doc_id"], "score")


@query("SELECT event_type, count(*) AS n, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END)::BIGINT AS ok FROM events GROUP BY 1")
def grade_summary(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum((F.col("value") > 50).cast("long")).alias("ok"))


@query(r"""SELECT doc_id, len(list_distinct(regexp_extract_all(text, '[0-9]+'))) AS numbers, len(list_intersect(list_distinct(regexp_extract_all(text, '[0-9]+')), (SELECT list(DISTINCT x) FROM (SELECT unnest(regexp_extract_all(text, '[0-9]+')) AS x FROM documents WHERE doc_id % 10 = 0)))) AS supported FROM documents""")
def number_support(spark, sf):
    """How many figures of a text a set of sources holds too."""
    docs = table(spark, sf, "documents")
    figures = F.array_distinct(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)))
    known = docs.where("doc_id % 10 = 0").select(F.explode(figures).alias("x")).distinct()
    held = docs.select("doc_id", F.explode(figures).alias("x")).join(known, "x", "left_semi").groupBy("doc_id").agg(F.count("*").alias("supported"))
    return docs.select("doc_id", F.size(figures).cast("long").alias("numbers")).join(held, "doc_id", "left").select("doc_id", "numbers", F.coalesce("supported", F.lit(0)).cast("long").alias("supported"))


@query(r"""SELECT w, CASE WHEN length(w) <= 4 OR regexp_matches(w, '[0-9]') THEN w WHEN ends_with(w, 'ies') AND length(w) > 5 THEN w[:-4] || 'y' WHEN ends_with(w, 'sses') THEN w[:-3] WHEN ends_with(w, 'ing') AND length(w) > 6 THEN w[:-4] WHEN ends_with(w, 'ed') AND length(w) > 5 THEN w[:-3]
WHEN regexp_matches(w, '[sxz]es$') AND length(w) > 5 THEN w[:-3] WHEN ends_with(w, 's') AND NOT regexp_matches(w, '(ss|us|is)$') THEN w[:-2] ELSE w END AS stem FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM documents)""")
def stems(spark, sf):
    words = search.document_frequency(table(spark, sf, "documents")).select(F.col("term").alias("w"))
    return words.select("w", stem(F.col("w")).alias("stem"))


@query("""SELECT p_partkey, round(235.215 / nullif(p_size::DOUBLE, 0), 6) AS consumption, round(p_size / 5.0 * 60 + p_retailprice / 600.0 * 60, 4) AS minutes, round(p_size * 7.0 / 100 * p_retailprice, 4) AS fuel, round(p_retailprice * 3.7 / 1000, 6) AS wh,
floor(p_retailprice * 0.65 / p_size + 1e-9)::BIGINT AS charges, round((p_size - 32) * 5.0 / 9, 6) AS celsius, round(1730.63 / (8.07131 - log10(101.325 * pow(1 - 2.25577e-5 * p_size * 100, 5.25588) * 7.50062)) - 233.426, 4) AS boiling, round(p_size * 1609.344::DOUBLE, 4) AS metres FROM part""")
def calc_numbers(spark, sf):
    size, price = F.col("p_size").cast("double"), F.col("p_retailprice")
    return table(spark, sf, "part").select(
        "p_partkey", F.round(calc.consumption(size), 6).alias("consumption"), F.round(calc.hiking_minutes(size, price), 4).alias("minutes"), F.round(calc.trip_fuel(size, F.lit(7.0), price), 4).alias("fuel"), F.round(calc.watt_hours(price), 6).alias("wh"),
        calc.charges(price, size).alias("charges"), F.round(calc.celsius(size), 6).alias("celsius"), F.round(calc.boiling(size * 100), 4).alias("boiling"), F.round(calc.convert(size, "mi", "m"), 4).alias("metres"),
    )


@query("SELECT o_orderkey, floor((o_orderkey % 1440 + o_custkey % 3000 + 60 * (o_orderkey % 7 - 3)) / 1440)::INT AS day, ((o_orderkey % 1440 + o_custkey % 3000 + 60 * (o_orderkey % 7 - 3)) % 1440 + 1440) % 1440 AS minute, ((o_custkey % 1440 - o_orderkey % 1440) % 1440 + 1440) % 1440 AS wait FROM orders")
def calc_clock(spark, sf):
    start = F.col("o_orderkey") % 1440
    at = calc.clock(start, F.col("o_custkey") % 3000, 60 * (F.col("o_orderkey") % 7 - 3))
    return table(spark, sf, "orders").select("o_orderkey", at["day"].alias("day"), at["minute"].cast("long").alias("minute"), calc.between(start, F.col("o_custkey") % 1440).alias("wait"))


@query()
def classifier_scores(spark, sf, sample_per_label: int = 40):
    """A hashed linear classifier, fitted on the whole texts of at most sample_per_label labelled rows of each kind, scores every document."""
    from pyspark.sql import Window as W

    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    marked = docs.select("doc_id", "lang", F.xxhash64("text").alias("_h"))
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "_h"))
    chosen = labels.select("doc_id").join(marked, "doc_id").withColumn("place", place).where(F.col("place") <= sample_per_label)
    chosen = F.broadcast(chosen.groupBy("doc_id", "lang", "_h").agg(F.count("*").cast("int").alias("_n")))  # texts are read again for these rows alone, neither joined nor sorted
    texts = docs.withColumn("_h", F.xxhash64("text")).join(chosen.withColumnRenamed("lang", "_l"), ["doc_id", "_h"]).where(F.col("lang").eqNullSafe(F.col("_l"))).dropDuplicates(["doc_id", "lang", "_h"])
    sample = texts.select("text", "lang", F.explode(F.array_repeat(F.lit(1), F.col("_n")))).orderBy(F.xxhash64("text")).collect()
    kinds = sorted({r["lang"] for r in sample})
    model = Softmax(kinds).fit([(r["text"], r["lang"]) for r in sample], rounds=3)
    return model.score(docs.select("doc_id", "text"), "doc_id", "text")
