"""Queries on search, merging and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions.text import query_terms, tokens
from siltstone.operators import merge, search, vectors
from siltstone.plans.base import registry
from siltstone.sources.stored import text_index
from siltstone.sources.tables import table

QUERIES, ORACLES, query = registry()
TERMS = ("nation", "thing", "heer", "stand", "tion")
_IN = ", ".join(f"'{t}'" for t in TERMS)
_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


def _bm25(docs: str, text: str = "text", terms: str = _IN) -> str:
    """SQL for (doc_id, score) over a relation with doc_id and text."""
    return f"""
    SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * words / greatest(1.0, avgwords)))) AS score FROM (
      SELECT doc_id, term, tf, words, count(*) OVER (PARTITION BY term) AS df FROM (
        SELECT doc_id, term, count(*) AS tf, any_value(words) AS words FROM (
          SELECT doc_id, len(w) AS words, unnest(w) AS term FROM (SELECT doc_id, regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+') AS w FROM {docs})) WHERE term IN ({terms}) GROUP BY doc_id, term))
    CROSS JOIN (SELECT count(*) AS n, avg(len(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+'))) AS avgwords FROM {docs})
    GROUP BY doc_id"""


_TITLED = "(SELECT doc_id, source, array_to_string(list_slice(string_split(string_split(text, chr(10))[1], ' '), 1, 6), ' ') AS title, text FROM documents)"
_RUNS = f"(SELECT d.source AS pack, s.doc_id, s.score FROM ({_bm25('documents')}) s JOIN documents d USING (doc_id))"


def _runs(spark, sf):
    docs = table(spark, sf, "documents")
    return text_index(spark, sf).bm25(TERMS).join(docs.select("doc_id", F.col("source").alias("pack")), "doc_id")


@query(f"SELECT doc_id, round(score, 6) AS score FROM ({_bm25('documents')}) ORDER BY score DESC, doc_id LIMIT 20")
def bm25_topk(spark, sf):
    """Full-text top 20."""
    return search.top(text_index(spark, sf).bm25(TERMS), 20).select("doc_id", F.round("score", 6).alias("score"))


@query(rf"""SELECT doc_id, round(score + 0.5 * least(3, len(list_filter(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1] IN ('the thing', 'thing of', 'of the', 'the that')))), 6) AS score FROM ({_bm25('documents', terms="'the', 'thing', 'of', 'that'")}) JOIN (SELECT doc_id, {_WORDS} AS w FROM documents) USING (doc_id)""")
def bm25_with_neighbours(spark, sf):
    """Every document that holds a word of the query, its score raised where words of the query stand side by side."""
    return text_index(spark, sf).bm25_near(["the", "thing", "of", "the", "that"]).select("doc_id", F.round("score", 6).alias("score"))


@query(f"SELECT doc_id, round(sum(score), 6) AS score FROM (SELECT doc_id, 3 * score AS score FROM ({_bm25(_TITLED, 'title')}) UNION ALL SELECT doc_id, score FROM ({_bm25('documents')})) GROUP BY doc_id ORDER BY sum(score) DESC, doc_id LIMIT 20")
def bm25_title_weighted(spark, sf):
    return search.top(text_index(spark, sf).title_weighted(TERMS), 20).select("doc_id", F.round("score", 6).alias("score"))


@query(f"SELECT t.doc_id, round(t.score, 6) AS score, length(d.text) AS n, md5(d.text) AS digest FROM (SELECT * FROM ({_bm25('documents')}) ORDER BY score DESC, doc_id LIMIT 20) t JOIN documents d USING (doc_id)")
def late_materialised_search(spark, sf):
    """The text joins only the rows that rank."""
    docs = table(spark, sf, "documents")
    best = search.top(text_index(spark, sf).bm25(TERMS), 20)
    return docs.join(F.broadcast(best), "doc_id").select("doc_id", F.round("score", 6).alias("score"), F.length("text").cast("long").alias("n"), F.md5("text").alias("digest"))


@query(rf"""SELECT doc_id, least(3, len(list_filter(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1] IN ('of the', 'in the', 'and the')))) AS pairs FROM (SELECT doc_id, {_WORDS} AS w FROM documents) WHERE list_contains(w, 'the')""")
def query_bigrams(spark, sf):
    """How often pairs of query words stand together."""
    docs = table(spark, sf, "documents")
    w = tokens(F.col("text"))
    n = F.greatest(F.size(w) - 1, F.lit(0))
    held = F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))
    pairs = F.size(F.filter(held, lambda p: p.isin("of the", "in the", "and the")))
    return docs.where(F.array_contains(w, "the")).select("doc_id", F.least(F.lit(3), pairs).cast("long").alias("pairs"))


@query(f"SELECT term, least(count(*), 400) AS df FROM (SELECT unnest(list_distinct({_WORDS})) AS term FROM documents) GROUP BY term ORDER BY count(*) DESC, term LIMIT 200")
def term_df_capped(spark, sf):
    df = text_index(spark, sf).terms.where("field = 'text'").orderBy(F.desc("df"), "term").limit(200)
    return df.select("term", F.least("df", F.lit(400)).cast("long").alias("df"))


@query(f"""WITH s AS (SELECT b.doc_id, b.score, len(list_intersect(list_distinct({_WORDS}), ['the', 'thing', 'tion'])) AS held FROM ({_bm25('documents', terms="'the', 'thing', 'tion'")}) b JOIN documents d USING (doc_id))
SELECT doc_id, min(stage) AS stage, round(any_value(score), 6) AS score FROM ((SELECT doc_id, 0 AS stage, score FROM s WHERE held = 3 ORDER BY score DESC, doc_id LIMIT 10) UNION ALL (SELECT doc_id, 1, score FROM s ORDER BY score DESC, doc_id LIMIT 30)) GROUP BY doc_id""")
def rare_term_conjunction_pool(spark, sf):
    return text_index(spark, sf).pool(("the", "thing", "tion"), 10).select("doc_id", "stage", F.round("score", 6).alias("score"))


@query(rf"""SELECT field, count(*) AS terms, sum(df)::BIGINT AS postings, sum(total)::BIGINT AS words FROM (
  SELECT field, term, count(DISTINCT doc_id) AS df, count(*) AS total FROM (
    SELECT 'text' AS field, doc_id, unnest({_WORDS}) AS term FROM documents UNION ALL
    SELECT 'title', doc_id, unnest(regexp_extract_all(lower(title), '[\p{{L}}\p{{N}}]+')) FROM {_TITLED}) GROUP BY 1, 2) GROUP BY 1""")
def stored_index(spark, sf):
    """What the stored index holds; the first query of an application that needs the index writes it."""
    terms = text_index(spark, sf).terms
    return terms.groupBy("field").agg(F.count("*").alias("terms"), F.sum("df").alias("postings"), F.sum("total").alias("words"))


@query(rf"""SELECT doc_id FROM (SELECT doc_id, {_WORDS} AS w, regexp_extract_all(lower(title), '[\p{{L}}\p{{N}}]+') AS t FROM {_TITLED})
WHERE (list_contains(w, 'thing') AND (len(list_filter(w, lambda x: starts_with(x, 'nat'))) > 0 OR list_contains(w, 'heer'))) OR list_contains(t, 'stand')""")
def fielded_match(spark, sf):
    """The query language: AND, OR, brackets, prefixes and fields, from postings alone."""
    return text_index(spark, sf).match("(text:thing AND (text:nat* OR text:heer)) OR title:stand")


@query(rf"""SELECT doc_id FROM (SELECT doc_id, ' ' || array_to_string({_WORDS}, ' ') || ' ' AS w FROM documents) WHERE contains(w, ' of the ') AND (contains(w, ' in the ') OR starts_with(w, ' the '))""")
def phrase_match(spark, sf):
    """Phrases and a first word, from the places in the postings; no text is read."""
    return text_index(spark, sf).match('text:"of the" (text:"in the" OR text:^the)')


@query(f"SELECT pack, doc_id, round(max(score) OVER (PARTITION BY pack) - score, 6) AS shift FROM {_RUNS}")
def pack_relative_shift(spark, sf):
    return merge.relative(_runs(spark, sf)).select("pack", "doc_id", F.round("shift", 6).alias("shift"))


@query(f"SELECT pack, doc_id, place, row_number() OVER (ORDER BY place, pack) AS turn FROM (SELECT pack, doc_id, row_number() OVER (PARTITION BY pack ORDER BY score DESC, doc_id) AS place FROM {_RUNS}) WHERE place <= 5")
def pack_round_robin(spark, sf):
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy("pack").orderBy(F.desc("score"), "doc_id"))
    return merge.round_robin(_runs(spark, sf).withColumn("_p", place).where("_p <= 5").drop("_p")).select("pack", "doc_id", F.col("place").cast("long").alias("place"), F.col("turn").cast("long").alias("turn"))


@query(f"""WITH r AS (SELECT *, max(score) OVER (PARTITION BY pack) - score AS shift, row_number() OVER (PARTITION BY pack ORDER BY score DESC, doc_id) AS place FROM {_RUNS}),
t AS (SELECT *, CASE WHEN place <= 2 THEN place - 1 WHEN place = 3 THEN 2 ELSE 3 END AS tier FROM r WHERE place <= 50),
c AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY tier, CASE WHEN tier < 2 THEN 0 ELSE shift END, pack, place) AS slot FROM t) WHERE slot <= 30)
SELECT pack, doc_id, slot, row_number() OVER (ORDER BY shift, slot) AS rank FROM c""")
def merge_runs(spark, sf):
    return merge.merge(_runs(spark, sf), 30).select("pack", "doc_id", F.col("slot").cast("long").alias("slot"), F.col("rank").cast("long").alias("rank"))


@query(f"SELECT title, min(doc_id) AS doc_id FROM {_TITLED} GROUP BY title ORDER BY length(title), min(doc_id) LIMIT 5000")
def title_min_row(spark, sf):
    return search.titles(table(spark, sf, "documents"))


@query(rf"""WITH w AS (SELECT doc_id, title, unnest(list_distinct(regexp_extract_all(lower(title), '[\p{{L}}\p{{N}}]+'))) AS term FROM {_TITLED})
SELECT term, title, doc_id, df FROM (SELECT *, count(*) OVER (PARTITION BY term) AS df, row_number() OVER (PARTITION BY term ORDER BY length(title), doc_id) AS n FROM w WHERE term IN ('the', 'of', 'and', 'tion', 'la', 'der', 'de', 'that', 'in', 'with')) WHERE n = 1 ORDER BY df, term LIMIT 8""")
def title_nominations(spark, sf):
    return search.nominate(table(spark, sf, "documents"), ("the", "of", "and", "tion", "la", "der", "de", "that", "in", "with"))


@query(r"""SELECT item_id, array_to_string(list_filter(list_distinct(list_filter(regexp_extract_all(lower(left(text, 512)), '[\p{L}\p{N}]+'), lambda x: length(x) >= 2)), lambda x: x NOT IN ('an','and','are','as','at','be','by','for','from','has','have','how','in','into','is','it','its','of','on','or','that','the','their','this','to','was','what','when','where','which','who','why','will','with','you','your')), ' ') AS terms FROM (SELECT item_id, regexp_replace(regexp_replace(text, '(\p{L})[''’](?:re|ll|ve|d|m|s)\b', '\1', 'g'), '(?i)n[''’]t\b', ' not', 'g') AS text FROM benchmark)""")
def query_terms_of_items(spark, sf):
    """Search terms of benchmark items; the order of first occurrence is kept."""
    items = table(spark, sf, "benchmark")
    return items.select("item_id", F.array_join(F.array_sort(query_terms(F.col("text"))), " ").alias("terms"))


ORACLES["query_terms_of_items"] = ORACLES["query_terms_of_items"].replace("array_to_string(list_filter(", "array_to_string(list_sort(list_filter(").replace("'your')), ' ')", "'your'))), ' ')").replace("'your'))))", "'your')))")


@query("""SELECT doc_id, n FROM (SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC) AS place FROM (SELECT doc_id, unnest(range(0, (length(text) + 999) // 1000)) AS n FROM documents)) WHERE place <= 2""")
def max_two_per_document(spark, sf):
    docs = table(spark, sf, "documents").where(F.length("text") > 0)
    n = F.explode(F.sequence(F.lit(0), F.ceil(F.length("text") / 1000).cast("int") - 1))
    chunks = docs.select("doc_id", n.alias("n")).withColumn("rank", -F.col("n"))
    return search.per_document(chunks, "doc_id").select("doc_id", F.col("n").cast("long").alias("n"))


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY source) AS m FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)) WHERE m <= 5 OR i IN (0, (m - 1) // 4, 2 * (m - 1) // 4, 3 * (m - 1) // 4, m - 1)")
def even_spread(spark, sf):
    return merge.spread(table(spark, sf, "documents").select("source", "doc_id"), "source", "doc_id", 5)


_UNIT = "(SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS u FROM embeddings)"
_Q = f"(SELECT vec_id, list_max(list_transform(u, lambda x: abs(x))) / 127 AS scale, list_transform(u, lambda x: round_even(x / (list_max(list_transform(u, lambda y: abs(y))) / 127), 0)) AS q FROM {_UNIT})"


@query(f"SELECT vec_id, round(scale, 8) AS scale, array_to_string(list_transform(q, lambda x: x::INT), ',') AS q FROM {_Q}")
def int8_quantise(spark, sf):
    found = vectors.quantise(table(spark, sf, "embeddings"))
    return found.select("vec_id", F.round("scale", 8).alias("scale"), F.concat_ws(",", F.col("q").cast("array<string>")).alias("q"))


@query(f"SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: q[i] * b[i])) / sqrt(list_sum(list_transform(q, lambda x: x * x))), 6) AS score FROM {_Q}, (SELECT u AS b FROM {_UNIT} WHERE vec_id = 7) WHERE len(q) = 64 ORDER BY list_sum(list_transform(range(1, 65), lambda i: q[i] * b[i])) / sqrt(list_sum(list_transform(q, lambda x: x * x))) DESC, vec_id LIMIT 25")
def cosine_topk(spark, sf):
    e = table(spark, sf, "embeddings")
    asked = e.where("vec_id = 7").first()["embedding"]
    return vectors.cosine_top(vectors.quantise(e), asked, 25).select("vec_id", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id, list_sum(list_transform(range(1, 65), lambda i: abs(q[i] * scale - u[i]))) < 64 * scale AS close FROM {_Q} JOIN {_UNIT} USING (vec_id)")
def dequantised(spark, sf):
    e = vectors.quantise(table(spark, sf, "embeddings")).withColumn("n", vectors.norm(F.col("embedding")))
    back = vectors.dequantise(F.col("q"), F.col("scale"), 64)
    off = F.aggregate(F.zip_with(back, "embedding", lambda a, b: F.struct(a.alias("a"), b.alias("b"))), F.lit(0.0), lambda s, x: s + F.abs(x["a"] - x["b"] / F.col("n")))
    return e.select("vec_id", (off < 64 * F.col("scale")).alias("close"))


def _nearest(spark, sf):
    """The registered search: every id divisible by 20 asks for 25 rows."""
    e = table(spark, sf, "embeddings")
    return vectors.nearest_of_all(vectors.ClusteredIndex(e, words=64), e, e.where("vec_id % 20 = 0"), 25)


@query()
def ivf_pq_topk(spark, sf):
    """Clustered search; its recall is tested against exact search."""
    return _nearest(spark, sf)


@query()
def ann_recall(spark, sf):
    """The recall of ivf_pq_topk, over all its queries and rows."""
    e = table(spark, sf, "embeddings")
    return vectors.recall_of_all(_nearest(spark, sf), vectors.exact_of_all(e, e.where("vec_id % 20 = 0"), 25))


@query(f"""WITH v AS (SELECT vec_id AS doc_id, list_sum(list_transform(range(1, 65), lambda i: q[i] * b[i])) / sqrt(list_sum(list_transform(q, lambda x: x * x))) AS score FROM {_Q}, (SELECT u AS b FROM {_UNIT} WHERE vec_id = 7) WHERE len(q) = 64 ORDER BY score DESC, vec_id LIMIT 10),
k AS (SELECT * FROM ({_bm25('documents')}) ORDER BY score DESC, doc_id LIMIT 20)
SELECT doc_id, tier, row_number() OVER (ORDER BY tier, place) AS rank FROM (SELECT doc_id, 0 AS tier, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM v UNION ALL SELECT doc_id, 1, row_number() OVER (ORDER BY score DESC, doc_id) FROM k WHERE doc_id NOT IN (SELECT doc_id FROM v))""")
def fuse_vector_ahead(spark, sf):
    """The ten vectors nearest to one, then the keyword hits that aren't among them."""
    e = table(spark, sf, "embeddings")
    near = vectors.cosine_top(vectors.quantise(e), e.where("vec_id = 7").first()["embedding"], 10).select(F.col("vec_id").alias("doc_id"), "score")
    found = merge.fuse(near, search.top(text_index(spark, sf).bm25(TERMS), 20))
    return found.select("doc_id", "tier", F.col("rank").cast("long").alias("rank"))
