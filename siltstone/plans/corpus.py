"""Queries on building and auditing a corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions.text import clean, plain_html, slug, without_lines
from siltstone.operators import audit, budget, chunking, search
from siltstone.plans.base import registry
from siltstone.sources.html import html_sections as sections_of
from siltstone.sources.tables import table

QUERIES, ORACLES, query = registry()
_HALF = "(SELECT doc_id, text FROM documents WHERE doc_id % 3 != 0)"


@query("SELECT lang, sha256(text) AS digest, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    docs = table(spark, sf, "documents").select("lang", F.sha2("text", 256).alias("digest"))
    return audit.duplicates(docs, "lang", "digest")


@query("SELECT source AS key, count(*) AS copies, count(DISTINCT sha256(text)) AS versions FROM documents GROUP BY source")
def dedupe_exact_conflict(spark, sf):
    return audit.conflicts(table(spark, sf, "documents"), "source", "text").withColumnRenamed("source", "key")


@query("SELECT DISTINCT doc_id, md5(text) AS digest FROM (SELECT * FROM documents UNION ALL SELECT * FROM documents WHERE doc_id % 2 = 0)")
def consolidate_packs(spark, sf):
    """Two collections put together: repeats go, conflicts would raise."""
    docs = table(spark, sf, "documents")
    return audit.consolidate(docs.unionByName(docs.where("doc_id % 2 = 0")), "doc_id", "text").select("doc_id", F.md5("text").alias("digest"))


@query("SELECT doc_id, md5(text) AS digest FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join_excluded(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti").select("doc_id", F.md5("text").alias("digest"))


@query("SELECT count(*) AS orphans FROM labels WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = labels.doc_id)")
def orphan_check(spark, sf):
    return table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id"), "doc_id", "left_anti").agg(F.count("*").alias("orphans"))


@query(f"""SELECT 'repeated' AS problem, (SELECT count(*) FROM (SELECT doc_id FROM {_HALF} GROUP BY 1 HAVING count(*) > 1)) AS n
UNION ALL SELECT 'missing', (SELECT count(*) FROM documents WHERE doc_id % 3 = 0) UNION ALL SELECT 'unmatched', 0""")
def vector_coverage(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    return audit.coverage(docs.where("doc_id % 3 != 0"), docs, "doc_id")


@query("""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'left' WHEN doc_id % 11 = 0 THEN 'changed' END AS side FROM documents WHERE doc_id % 7 = 0 OR doc_id % 11 = 0""")
def full_equality_audit(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    other = docs.where("doc_id % 7 != 0").withColumn("lang", F.when(F.col("doc_id") % 11 == 0, "xx").otherwise(F.col("lang")))
    return audit.differences(docs, other, "doc_id")


@query("SELECT count(*) AS n, sum(('0x' || left(sha256('{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\"}'), 12))::HUGEINT)::VARCHAR AS digest FROM documents")
def content_digest(spark, sf):
    return audit.digest(table(spark, sf, "documents"), "doc_id", "lang").select("n", F.col("digest").cast("string").alias("digest"))


@query()
def overlap_chunks(spark, sf):
    return chunking.chunk(table(spark, sf, "documents")).select("doc_id", "n", "chunk_id", F.length("text").alias("size"), F.md5("text").alias("digest"))


@query("SELECT doc_id, true AS joined, true AS overlaps FROM documents WHERE length(text) > 0")
def overlap_audit(spark, sf):
    """Every document's pieces make its text again, and each begins with the end of the one before."""
    docs = table(spark, sf, "documents")
    return chunking.audit(chunking.chunk(docs), docs).select("doc_id", "joined", "overlaps")


@query("SELECT doc_id, count(*) FILTER (length(p) > 0) AS n_paragraphs, sum(length(p))::BIGINT AS chars FROM (SELECT doc_id, trim(unnest(regexp_split_to_array(text, '\\n\\s*\\n')), E' \\t\\n\\r\\f\\x0b') AS p FROM documents) GROUP BY doc_id HAVING count(*) FILTER (length(p) > 0) > 0")
def paragraph_chunks(spark, sf):
    """Paragraphs, and how many characters they hold: cutting by paragraphs keeps all of them."""
    chunks = chunking.chunk(table(spark, sf, "documents"), chunking.paragraphs)
    parts = F.split("text", "\n\n")
    return chunks.groupBy("doc_id").agg(F.sum(F.size(parts)).alias("n_paragraphs"), F.sum(F.aggregate(parts, F.lit(0), lambda s, x: s + F.length(x))).alias("chars"))


@query()
def attachment_passages(spark, sf):
    return chunking.chunk(table(spark, sf, "documents"), chunking.passages).select("doc_id", "n", F.length("text").alias("size"))


@query()
def line_chunks(spark, sf):
    return chunking.chunk(table(spark, sf, "documents"), chunking.lines).select("doc_id", "n", F.length("text").alias("size"))


@query()
def continued_chunks(spark, sf):
    return chunking.continued(chunking.chunk(table(spark, sf, "documents"))).select("doc_id", "n", F.length("next").alias("more"))


@query("SELECT source, doc_id, used_before FROM (SELECT source, doc_id, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used_before FROM documents) WHERE used_before < 40000")
def budget_prefix(spark, sf):
    return budget.prefix(table(spark, sf, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id", "n_chars", 40_000).select("source", "doc_id", "used_before")


@query("""WITH RECURSIVE o AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
f AS (SELECT source, i, doc_id, CASE WHEN n_chars <= 40000 THEN n_chars ELSE 0 END AS used, n_chars <= 40000 AS kept FROM o WHERE i = 1
UNION ALL SELECT o.source, o.i, o.doc_id, CASE WHEN f.used + o.n_chars <= 40000 THEN f.used + o.n_chars ELSE f.used END, f.used + o.n_chars <= 40000 FROM f JOIN o ON o.source = f.source AND o.i = f.i + 1)
SELECT source, doc_id FROM f WHERE kept""")
def budget_with_skips(spark, sf):
    return budget.with_skips(table(spark, sf, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id", "n_chars", 40_000).select("source", "doc_id")


@query("""WITH RECURSIVE o AS (SELECT lang, doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i FROM documents),
f AS (SELECT lang, i, doc_id, 0 AS module, 1 AS c, n_chars AS used FROM o WHERE i = 1
UNION ALL SELECT o.lang, o.i, o.doc_id, CASE WHEN f.c + 1 > 12 OR f.used + o.n_chars > 60000 THEN f.module + 1 ELSE f.module END, CASE WHEN f.c + 1 > 12 OR f.used + o.n_chars > 60000 THEN 1 ELSE f.c + 1 END, CASE WHEN f.c + 1 > 12 OR f.used + o.n_chars > 60000 THEN o.n_chars ELSE f.used + o.n_chars END
FROM f JOIN o ON o.lang = f.lang AND o.i = f.i + 1) SELECT lang, doc_id, module FROM f""")
def module_packing(spark, sf):
    return budget.modules(table(spark, sf, "documents"), "lang", "doc_id", "n_chars", 12, 60_000)


@query("""SELECT user_id, round(sum(d), 4) AS final, round(max(s), 4) AS peak FROM (SELECT user_id, d, sum(d) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM (SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN -value ELSE value END AS d FROM events)) GROUP BY user_id""")
def storage_peak(spark, sf):
    change = F.when(F.col("event_id") % 3 == 0, -F.col("value")).otherwise(F.col("value"))
    found = budget.peak(table(spark, sf, "events").withColumn("d", change), "user_id", "event_id", "d")
    return found.select("user_id", F.round("final", 4).alias("final"), F.round("peak", 4).alias("peak"))


@query(r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, E'\r\n?', E'\n', 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '[ \t]+', ' ', 'g'), E'\n{3,}', E'\n\n', 'g'))) AS digest FROM documents""")
def cleaned_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(clean(F.col("text"))).alias("digest"))


@query(r"""SELECT doc_id, CASE WHEN b = '' THEN h ELSE b || '-' || h END AS slug FROM (SELECT doc_id, left(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 40) AS b, left(sha256(doc_id::VARCHAR), 12) AS h FROM documents)""")
def slug_ids(spark, sf):
    return table(spark, sf, "documents").select("doc_id", slug(F.col("text"), F.col("doc_id").cast("string")).alias("slug"))


@query(r"""SELECT doc_id, md5(array_to_string(list_filter(string_split(text, chr(10)), lambda l: NOT starts_with(lower(ltrim(l, ' ')), 'the')), chr(10))) AS digest FROM documents""")
def without_marked_lines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(without_lines(F.col("text"), "The")).alias("digest"))


@query(r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM pages""")
def html_to_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", plain_html(F.col("html")).alias("text"))


@query()
def html_sections(spark, sf):
    return sections_of(table(spark, sf, "pages"))


@query("SELECT source, count(*) AS n FROM documents WHERE text IS NOT NULL AND length(text) > 0 GROUP BY source")
def passage_titles(spark, sf):
    return search.passages(table(spark, sf, "documents")).where(F.length("text") > 0).groupBy("source").agg(F.count("title").alias("n"))
