"""Queries on evidence for questions of several parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions.text import query_terms, tokens
from siltstone.operators import coverage, depth
from siltstone.plans.base import registry
from siltstone.sources.tables import table, written

QUERIES, ORACLES, query = registry()

#: Six long words of each benchmark item, of which its question is made.
_ITEMS = r"""items AS (SELECT item_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda w: length(w) >= 7)))[1:6] AS t FROM benchmark),
asked AS (SELECT item_id, t FROM items WHERE len(t) = 6)"""


def _asked(spark, sf):
    long = F.filter(tokens(F.col("text")), lambda w: F.length(w) >= 7)
    rows = table(spark, sf, "benchmark").select("item_id", F.slice(F.array_sort(F.array_distinct(long)), 1, 6).alias("t"))
    return rows.where(F.size("t") == 6)


def _said(*parts):
    """Words of a question: text as it is, numbers as the item's words."""
    return F.concat(*(F.get("t", F.lit(p)) if isinstance(p, int) else F.lit(p) for p in parts))


@query(f"""WITH {_ITEMS}, split AS (SELECT item_id, CASE item_id % 5 WHEN 0 THEN ['What is ' || t[1] || ' ' || t[2], 'how is ' || t[3] || ' ' || t[4] || '?'] WHEN 1 THEN ['What is ' || t[1] || ' ' || t[2], 'Why is ' || t[3] || ' ' || t[4], 'when is ' || t[5] || ' ' || t[6] || '?']
 WHEN 3 THEN ['Describe ' || t[1] || ' ' || t[2], 'where is ' || t[5] || ' ' || t[6] || '?'] ELSE [] END AS l FROM asked) SELECT item_id, unnest(l) AS clause, unnest(range(1, len(l) + 1)) AS n FROM split""")
def question_clauses(spark, sf):
    """The parts of questions in five forms: joined, in a row, quoted, bracketed and plain."""
    forms = (
        _said("What is ", 0, " ", 1, " and how is ", 2, " ", 3, "?"), _said("What is ", 0, " ", 1, "? Why is ", 2, " ", 3, "; when is ", 4, " ", 5, "?"), _said('What is "', 0, " and what is ", 1, '" or ', 2, "?"),
        _said("Describe ", 0, " ", 1, " (", 2, " and how (", 3, ") is) and where is ", 4, " ", 5, "?"), _said(0, " ", 1, " ", 2),
    )
    rows = _asked(spark, sf).withColumn("question", F.get(F.array(*forms), (F.col("item_id") % 5).cast("int")))
    return rows.select("item_id", F.posexplode(coverage.clauses(F.col("question"))).alias("n", "clause")).select("item_id", "clause", (F.col("n") + 1).cast("long").alias("n"))


def _merged(rows: str, limit: str, first: str) -> str:
    """SQL for a keyed merge of rows (item_id, pack, doc_id, score)."""
    order = "tier, CASE WHEN tier < 2 THEN 0 ELSE shift END, head DESC, pack, place"
    return f"""SELECT item_id, pack, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY first DESC, shift, slot) AS rank FROM (
 SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY {order}) AS slot FROM (SELECT *, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY {order}) AS same FROM (
  SELECT *, max(CASE WHEN place = 1 THEN first::INT END) OVER (PARTITION BY item_id, pack) AS head, CASE WHEN place <= 2 THEN place - 1 WHEN place = 3 THEN 2 ELSE 3 END AS tier FROM (
   SELECT *, row_number() OVER (PARTITION BY item_id, pack ORDER BY first DESC, score DESC, doc_id) AS place, max(score) OVER (PARTITION BY item_id, pack) - score AS shift FROM (SELECT *, {first} AS first FROM {rows})) WHERE place <= 50)) WHERE same = 1) WHERE slot <= {limit}"""


_JUDGED = rf"""{_ITEMS},
words AS (SELECT doc_id, source AS pack, list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS w FROM documents),
matched AS (SELECT item_id, doc_id, count(*) AS n FROM (SELECT item_id, unnest(t) AS w FROM asked) JOIN (SELECT doc_id, unnest(w) AS w FROM words) USING (w) GROUP BY item_id, doc_id),
hits AS (SELECT item_id, doc_id, pack, n * 100 - least(99, len(w) // 10) AS score, [len(list_filter(x, lambda u: len(list_filter(w, lambda v: starts_with(v, u))) > 0)) FOR x IN [t[1:3], t[4:6]]] AS h FROM matched JOIN asked USING (item_id) JOIN words USING (doc_id)),
judged AS (SELECT item_id, doc_id, pack, score, h[1] + h[2] = 6 AS covers, item_id % 2 = 0 AS parted, h[1] >= 2 AS s1, h[2] >= 2 AND (item_id % 4 = 2 OR h[1] > 0) AS s2, CASE WHEN item_id % 2 = 0 THEN h[1] >= 2 OR h[2] >= 2 AND (item_id % 4 = 2 OR h[1] > 0) ELSE h[1] + h[2] >= 3 END AS eligible, item_id % 4 = 3 AND doc_id % 7 = 0 AS focus FROM hits)"""


def _judged(spark, sf):
    asked = _asked(spark, sf)
    parted = F.when(F.col("item_id") % 4 == 0, _said("What is ", 0, " ", 1, " ", 2, " and how is ", 3, " ", 4, " ", 5, "?")).when(F.col("item_id") % 4 == 2, _said("What is ", 0, " ", 1, " ", 2, ", and what is ", 3, " ", 4, " ", 5, "?"))
    questions = asked.select("item_id", F.coalesce(parted, F.array_join("t", " ")).alias("question"))
    docs = table(spark, sf, "documents")
    words = docs.select("doc_id", F.col("source").alias("pack"), F.array_distinct(tokens(F.col("text"))).alias("w"), F.monotonically_increasing_id().alias("_row"))
    terms = questions.select("item_id", F.explode(query_terms(F.col("question"))).alias("_t"))
    spoken = words.select("_row", "doc_id", "pack", F.size("w").alias("m"), F.explode("w").alias("_w"))
    held = written(coverage.telling(spoken, terms, "_w", "_t").groupBy("_row", "doc_id", "pack", "m").agg(F.collect_list("_w").alias("w")).drop("_row"), "telling").repartition("doc_id")
    scored = held.select("doc_id", "m", F.explode("w").alias("_w")).join(terms, F.col("_w") == F.col("_t")).groupBy("item_id", "doc_id").agg((F.count("*") * 100 - F.least(F.lit(99), F.floor(F.first("m") / 10))).alias("score"))
    rows = scored.join(held.select("doc_id", "pack", "w"), "doc_id")
    return coverage.judged(rows, questions, "item_id", words="w").drop("w")


@query(f"WITH {_JUDGED} SELECT item_id, doc_id, eligible, covers, CASE WHEN parted THEN s1::INT + s2::INT ELSE 0 END::BIGINT AS served FROM judged")
def evidence_judged(spark, sf):
    """Passages against questions with and without parts: whether they are relevant, cover everything, and how many parts they serve."""
    return _judged(spark, sf).select("item_id", "doc_id", "eligible", "covers", F.size(F.filter("parts", lambda p: p)).cast("long").alias("served"))


@query(f"""WITH {_JUDGED}, kept AS (SELECT *, max(focus) OVER (PARTITION BY item_id) AS focused FROM (SELECT *, row_number() OVER (PARTITION BY item_id, pack ORDER BY focus DESC, covers DESC, score DESC, doc_id) AS p FROM judged WHERE eligible) WHERE p <= 50),
front AS ({_merged("(SELECT * FROM kept WHERE focus)", "8", "false")}),
served AS (SELECT *, s1::INT + s2::INT AS most FROM kept WHERE parted AND NOT focused),
firm AS (SELECT item_id, any_value(pack) AS pack, doc_id, min(c) AS c FROM (SELECT item_id, pack, doc_id, 0 AS c, row_number() OVER (PARTITION BY item_id ORDER BY most DESC, pack, score DESC, doc_id) AS r FROM served WHERE s1 UNION ALL SELECT item_id, pack, doc_id, 1, row_number() OVER (PARTITION BY item_id ORDER BY most DESC, pack, score DESC, doc_id) FROM served WHERE s2) WHERE r = 1 GROUP BY item_id, doc_id),
ahead AS (SELECT item_id, pack, doc_id, 0 AS tier, rank FROM front UNION ALL SELECT item_id, pack, doc_id, 1, row_number() OVER (PARTITION BY item_id ORDER BY c) FROM firm),
rest AS (SELECT k.*, 8 - coalesce((SELECT count(*) FROM ahead a WHERE a.item_id = k.item_id), 0) AS room FROM kept k WHERE NOT focus AND NOT EXISTS (SELECT 1 FROM ahead a WHERE a.item_id = k.item_id AND a.doc_id = k.doc_id)),
every AS (SELECT * FROM ahead UNION ALL SELECT item_id, pack, doc_id, 2, rank FROM ({_merged("rest", "room", "covers")}))
SELECT item_id, pack, doc_id, tier::INT AS tier, row_number() OVER (PARTITION BY item_id ORDER BY tier, rank) AS rank FROM every""")
def evidence_merged(spark, sf):
    """The eight best passages of each question over all collections: exact conditions, then an anchor for each part, then by coverage and strength."""
    focus = (F.col("item_id") % 4 == 3) & (F.col("doc_id") % 7 == 0)
    return coverage.merge_relevant(_judged(spark, sf), 8, "item_id", focus=focus).withColumn("rank", F.col("rank").cast("long"))


_FOUND = "len(list_filter({terms}, lambda u: len(list_filter({words}, lambda v: v = u OR length(u) >= 4 AND starts_with(v, u))) > 0))"
_WORDS_OF = r"regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+')"
_DEPTH = rf"""{_ITEMS},
subjects AS (SELECT item_id, t[1:4] AS terms, 'src' || item_id % 20 AS article, 0 AS slot, 1200 AS share FROM asked UNION ALL SELECT item_id, t[1:4], 'src' || (item_id + 7) % 20, 1, 800 FROM asked),
pieces AS (SELECT source AS article, doc_id AS doc, lead, heading, unnest(range(0, greatest(1, ceil((length(text) - 150) / 450.0))::BIGINT)) AS n, text AS whole FROM (SELECT source, doc_id, text, doc_id = min(doc_id) OVER (PARTITION BY source) AS lead,
 CASE doc_id % 5 WHEN 0 THEN 'Causes' WHEN 1 THEN 'History > Notes' WHEN 2 THEN 'Background > Notes' ELSE 'Notes > ' || string_split(text, ' ')[1] END AS heading FROM documents WHERE text IS NOT NULL)),
passages AS (SELECT article, doc, lead, heading, n, substr(whole, 1 + 450 * n, 600) AS text FROM pieces QUALIFY row_number() OVER (PARTITION BY article ORDER BY lead DESC, doc, n) <= 200),
scored AS (SELECT item_id, slot, share, p.article, doc, n, lead, length(text) AS size, text, CASE doc % 5 WHEN 0 THEN 3 WHEN 2 THEN 2 ELSE 0 END + 2 * {_FOUND.format(terms="terms", words=_WORDS_OF.format(text="heading"))} + {_FOUND.format(terms="terms", words=_WORDS_OF.format(text="text"))} AS score FROM passages p JOIN subjects s USING (article)),
best AS (SELECT *, max(score) OVER (PARTITION BY item_id, slot, doc) AS b, lead AND row_number() OVER (PARTITION BY item_id, slot, lead ORDER BY doc, n) = 1 AS opens FROM scored),
late AS (SELECT *, coalesce(max(CASE WHEN opens THEN size END) OVER (PARTITION BY item_id, slot) + first_value(CASE WHEN NOT lead AND b > 0 THEN size END) OVER (PARTITION BY item_id, slot ORDER BY lead OR b <= 0, -b, doc, n) > share, false) AS late FROM best),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id, slot ORDER BY CASE WHEN opens THEN CASE WHEN late THEN 2 ELSE 0 END WHEN NOT lead AND b > 0 THEN 1 WHEN lead THEN 3 ELSE 4 END, CASE WHEN lead THEN 0 ELSE -b END, doc, n) AS place FROM late)"""
_PICKED = r"""queue AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY place, slot, doc, n) AS r FROM ranked),
fold AS (SELECT item_id, 0::BIGINT AS r, 1200 AS l0, 800 AS l1, []::STRUCT(doc BIGINT, n BIGINT, size BIGINT)[] AS taken, []::STRUCT(doc BIGINT, n BIGINT, size BIGINT)[] AS wait FROM asked
 UNION ALL SELECT item_id, r, CASE WHEN slot = 0 AND used IS NOT NULL THEN l0 - used ELSE l0 END, CASE WHEN slot = 1 AND used IS NOT NULL THEN l1 - used ELSE l1 END, CASE WHEN used IS NULL THEN taken ELSE list_append(taken, {'doc': doc, 'n': n, 'size': CASE WHEN price <= room THEN size ELSE used END}) END, CASE WHEN used IS NULL THEN list_append(wait, {'doc': doc, 'n': n, 'size': size}) ELSE wait END
 FROM (SELECT *, CASE WHEN price <= room THEN price WHEN opens AND cut >= 240 THEN cut END AS used FROM (SELECT *, CASE WHEN opens THEN list_max(list_filter(range(1, length(text)), lambda i: regexp_matches(substr(text, i, 2), '^[.!?]\s$') AND i <= room)) END AS cut
  FROM (SELECT f.*, q.r AS r1, q.slot, q.doc, q.n, q.size, q.opens, q.text, CASE q.slot WHEN 0 THEN l0 ELSE l1 END AS room, q.size - CASE WHEN len(list_filter(f.taken, lambda t: t.doc = q.doc AND t.n + 1 = q.n)) > 0 THEN 150 ELSE 0 END AS price FROM fold f JOIN queue q ON q.item_id = f.item_id AND q.r = f.r + 1)) x) y(item_id, r0, l0, l1, taken, wait, r, slot, doc, n, size, opens, text, room, price, cut, used)),
done AS MATERIALIZED (SELECT * FROM fold QUALIFY r = max(r) OVER (PARTITION BY item_id) AND r > 0),
rest AS (SELECT item_id, wait, taken, 0 AS i, l0 + l1 AS room FROM done UNION ALL SELECT item_id, wait, CASE WHEN price <= room THEN list_append(taken, wait[i + 1]) ELSE taken END, i + 1, CASE WHEN price <= room THEN room - price ELSE room END
 FROM (SELECT *, wait[i + 1].size - CASE WHEN len(list_filter(taken, lambda t: t.doc = wait[i + 1].doc AND t.n + 1 = wait[i + 1].n)) > 0 THEN 150 ELSE 0 END AS price FROM rest WHERE i < len(wait))),
picked AS (SELECT item_id, unnest(taken, recursive := true), unnest(range(len(taken))) AS turn FROM (SELECT * FROM rest QUALIFY i = max(i) OVER (PARTITION BY item_id)))"""


def _depth(spark, sf):
    asked = _asked(spark, sf)
    subjects = [asked.select("item_id", _said("Why ", 0, " ", 1, " ", 2, " ", 3, "?").alias("question"), F.concat(F.lit("src"), (F.col("item_id") + 7 * slot) % 20).alias("article"), F.lit(slot).alias("slot"), F.lit(share).alias("share")) for slot, share in ((0, 1200), (1, 800))]
    docs = table(spark, sf, "documents").where("text is not null")
    first = docs.groupBy(F.col("source").alias("_s")).agg(F.min("doc_id").alias("_first"))
    heading = F.when(F.col("doc_id") % 5 == 0, "Causes").when(F.col("doc_id") % 5 == 1, "History > Notes").when(F.col("doc_id") % 5 == 2, "Background > Notes").otherwise(F.concat(F.lit("Notes > "), F.get(F.split("text", " "), F.lit(0))))
    last = F.greatest(F.lit(1), F.ceil((F.length("text") - 150) / 450).cast("int")) - 1
    docs = docs.join(first, F.col("source") == F.col("_s")).select(F.col("source").alias("article"), F.col("doc_id").alias("doc"), (F.col("doc_id") == F.col("_first")).alias("lead"), heading.alias("heading"), "text", F.explode(F.sequence(F.lit(0), last)).alias("n"))
    passages = docs.withColumn("text", F.substring(F.col("text"), F.col("n") * 450 + 1, F.lit(600)))
    return depth.ranked(passages, subjects[0].unionByName(subjects[1]), "item_id"), passages


@query(f"WITH {_DEPTH} SELECT item_id, slot, doc, n, score, place FROM ranked")
def depth_ranked(spark, sf):
    """Pieces of two articles for each question, in the order in which they are worth reading."""
    return _depth(spark, sf)[0].select("item_id", "slot", "doc", F.col("n").cast("long").alias("n"), F.col("score").cast("long").alias("score"), F.col("place").cast("long").alias("place"))


@query(f"WITH RECURSIVE {_DEPTH}, {_PICKED} SELECT item_id, doc, n, size, turn FROM picked")
def depth_picked(spark, sf):
    """The pieces that 2000 characters hold, 1200 for the first article and 800 for the second."""
    rows, passages = _depth(spark, sf)
    return depth.pick(rows, passages, "item_id", 2000).select("item_id", "doc", F.col("n").cast("long").alias("n"), F.col("size").cast("long").alias("size"), F.col("turn").cast("long").alias("turn"))


@query(rf"""WITH RECURSIVE {_DEPTH}, {_PICKED}, told AS (SELECT k.*, left(substr(d.text, 1 + 450 * n, 600), size) AS t, min(turn) OVER (PARTITION BY item_id, doc) AS seen, n - row_number() OVER (PARTITION BY item_id, doc ORDER BY n) AS run FROM picked k JOIN documents d ON d.doc_id = k.doc),
own AS (SELECT *, CASE WHEN b IS NULL THEN t WHEN ends_with(b, left(t, 150)) THEN substr(t, 151) ELSE ' ' || t END AS o FROM (SELECT *, lag(t) OVER (PARTITION BY item_id, doc, run ORDER BY n) AS b FROM told))
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY seen, first) AS place, doc, first, last, md5(text) AS digest FROM (SELECT item_id, doc, run, any_value(seen) AS seen, min(n) AS first, max(n) AS last, regexp_replace(string_agg(o, '' ORDER BY n), '^\s+|\s+$', '', 'g') AS text FROM own GROUP BY item_id, doc, run)""")
def depth_texts(spark, sf):
    """What was picked, neighbouring pieces as one text."""
    rows, passages = _depth(spark, sf)
    found = depth.joined(depth.pick(rows, passages, "item_id", 2000), passages, "item_id")
    return found.select("item_id", F.col("place").cast("long").alias("place"), "doc", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), F.md5("text").alias("digest"))
