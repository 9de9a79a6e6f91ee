"""Queries on destinations, opening hours and guides."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import hours
from siltstone.functions import text as T
from siltstone.operators import destinations
from siltstone.plans.base import registry
from siltstone.sources import guides
from siltstone.sources.tables import dealt, table

QUERIES, ORACLES, query = registry()


def _listed(words) -> str:
    return ", ".join(f"'{w}'" for w in sorted(words))


#: Titles of listings, of each document's first words: a destination of one word, one of two, or a destination with a district.
_TITLES = """titled AS (SELECT doc_id, source, [regexp_replace(x, '[^\\p{L}]', '', 'g') FOR x IN string_split_regex(text, '\\s+')] AS x FROM documents),
titles AS (SELECT doc_id, x[1] || CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN ' ' || x[2] ELSE '/' || x[2] END || ' — ' || source AS title FROM titled WHERE len(x) > 1),
named AS (SELECT doc_id, title, string_split(split_part(lower(strip_accents(title)), ' — ', 1), '/') AS parts FROM titles),
heads AS (SELECT doc_id, title, unnest([array_to_string(parts[1:i], '/') FOR i IN range(1, len(parts) + 1)]) AS key FROM named)"""

_PHRASES = f"""clauses AS (SELECT conv_id, turn, unnest(l) AS t, unnest(range(len(l))) AS clause FROM (SELECT conv_id, turn, string_split_regex(text, '[,;:.?!()\\[\\]"“”\\n]+') AS l FROM conversations)),
pieces AS (SELECT conv_id, turn, clause, unnest(l) AS w, unnest(range(len(l))) AS i FROM (SELECT conv_id, turn, clause, regexp_extract_all(t, '[\\p{{L}}\\p{{N}}]+(?:[''’-][\\p{{L}}\\p{{N}}]+)*') AS l FROM clauses)),
words AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY clause, i) - 1 AS pos, lower(w) AS low, regexp_matches(w, '^\\p{{Lu}}') AS cap, lower(w) IN ({_listed(destinations.JOINERS)}) AS j, lower(w) IN ({_listed(destinations.BEFORE)}) AS p,
 length(w) < 2 OR lower(w) IN ({_listed(T.STOPWORDS)}) AS filler, lower(w) IN ({_listed(destinations.OPENERS)}) AS opener FROM pieces),
marked AS (SELECT *, sum((NOT (cap OR j))::INT) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS bad, count(*) OVER (PARTITION BY conv_id, turn) AS n FROM words),
caps AS (SELECT a.conv_id, a.turn, a.pos, any_value(a.low) AS low, coalesce(max(b.pos) + 1, a.pos) AS e FROM marked a LEFT JOIN marked b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.clause = b.clause AND b.pos BETWEEN a.pos AND a.pos + 5 AND NOT b.j AND a.bad = b.bad WHERE a.cap GROUP BY a.conv_id, a.turn, a.pos),
after AS (SELECT a.conv_id, a.turn, a.pos, any_value(a.e) AS e, any_value(a.low) AS low, min(b.pos) AS nxt FROM caps a LEFT JOIN caps b ON a.conv_id = b.conv_id AND a.turn = b.turn AND b.pos >= greatest(a.e, a.pos + 1) GROUP BY a.conv_id, a.turn, a.pos),
runs AS (SELECT conv_id, turn, pos, e, low, nxt FROM (SELECT *, min(pos) OVER (PARTITION BY conv_id, turn) AS first FROM after) WHERE pos = first UNION ALL SELECT a.conv_id, a.turn, a.pos, a.e, a.low, a.nxt FROM runs r JOIN after a ON a.conv_id = r.conv_id AND a.turn = r.turn AND a.pos = r.nxt),
within AS (SELECT conv_id, turn, pos AS a, e AS z FROM runs WHERE e > pos AND NOT (pos = 0 AND e = 1 AND low IN ({_listed(destinations.OPENERS)}))
 UNION SELECT m.conv_id, m.turn, m.pos + 1, coalesce(min(b.pos), least(any_value(m.n), m.pos + 5)) FROM marked m LEFT JOIN marked b ON m.conv_id = b.conv_id AND m.turn = b.turn AND b.pos BETWEEN m.pos + 1 AND m.pos + 4 AND (b.clause <> m.clause OR b.p OR b.filler OR b.opener) WHERE m.p GROUP BY m.conv_id, m.turn, m.pos),
spans AS (SELECT DISTINCT w.conv_id, w.turn, s.pos AS s, s.pos + k.len AS e FROM within w JOIN marked s ON s.conv_id = w.conv_id AND s.turn = w.turn AND s.pos >= w.a AND s.pos < w.z JOIN (SELECT unnest([1, 2, 3, 4]) AS len) k ON s.pos + k.len <= w.z),
phrases AS (SELECT x.conv_id, x.turn, s, e, string_agg(m.w, ' ' ORDER BY m.pos) AS phrase FROM spans x JOIN marked m ON m.conv_id = x.conv_id AND m.turn = x.turn AND m.pos >= s AND m.pos < e GROUP BY x.conv_id, x.turn, s, e HAVING NOT bool_and(m.j OR m.filler) AND NOT bool_or(m.j AND (m.pos = s OR m.pos = e - 1))),
confirmed AS (SELECT conv_id, turn, s, e, phrase, lower(strip_accents(phrase)) AS key, row_number() OVER (PARTITION BY conv_id, turn ORDER BY s - e, s) AS n FROM phrases WHERE lower(strip_accents(phrase)) IN (SELECT key FROM heads)),
taken AS (SELECT conv_id, turn, n, range(s, e) AS used, true AS kept FROM confirmed WHERE n = 1 UNION ALL SELECT c.conv_id, c.turn, c.n, CASE WHEN list_has_any(t.used, range(c.s, c.e)) THEN t.used ELSE list_concat(t.used, range(c.s, c.e)) END, NOT list_has_any(t.used, range(c.s, c.e)) FROM taken t JOIN confirmed c ON c.conv_id = t.conv_id AND c.turn = t.turn AND c.n = t.n + 1),
once AS (SELECT c.conv_id, c.turn, lower(phrase) AS low, min_by(phrase, c.n) AS destination, min_by(key, c.n) AS key, min(c.n) AS n FROM confirmed c JOIN taken t ON c.conv_id = t.conv_id AND c.turn = t.turn AND c.n = t.n WHERE kept GROUP BY ALL),
resolved AS (SELECT conv_id, turn, destination, key, row_number() OVER (PARTITION BY conv_id, turn ORDER BY n) AS place FROM once)"""


def _titles(spark, sf):
    x = F.transform(F.split("text", r"\s+"), lambda w: F.regexp_replace(w, r"[^\p{L}]", ""))
    docs = table(spark, sf, "documents").select("doc_id", "source", x.alias("x")).where(F.size("x") > 1)
    more = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, F.concat(F.lit(" "), F.col("x")[1])).otherwise(F.concat(F.lit("/"), F.col("x")[1]))
    return docs.select("doc_id", F.concat(F.col("x")[0], more, F.lit(" — "), "source").alias("title"))


@query(f"WITH RECURSIVE {_TITLES}, {_PHRASES} SELECT conv_id, turn, destination, place FROM resolved")
def destinations_named(spark, sf):
    return destinations.resolve(table(spark, sf, "conversations"), _titles(spark, sf), ["conv_id", "turn"]).select("conv_id", "turn", "destination", "place")


@query(f"WITH RECURSIVE {_TITLES}, {_PHRASES} SELECT conv_id, turn, destination, count(*) AS titles, min(doc_id) AS first_title FROM resolved JOIN heads USING (key) GROUP BY conv_id, turn, destination")
def destination_titles(spark, sf):
    titles = _titles(spark, sf)
    found = destinations.resolve(table(spark, sf, "conversations"), titles, ["conv_id", "turn"])
    return destinations.scoped(found, titles).groupBy("conv_id", "turn", "destination").agg(F.count("*").alias("titles"), F.min("doc_id").alias("first_title"))


#: Hours of seven forms, with times that follow from the key; b may lie past midnight. The minute asked about follows from it too.
_HOURS = """f AS (SELECT c_custkey AS id, c_nationkey, c_custkey % 7 AS form, 360 + c_custkey * 37 % 300 AS a, 480 + c_custkey * 37 % 300 + c_custkey * 53 % 900 AS b, c_custkey * 797 % 10080 AS moment FROM customer),
spans AS (SELECT id, d, unnest(CASE WHEN form IN (2, 6) AND NOT (form = 2 AND d = 5) THEN [{'x': a, 'y': a + 60}, {'x': a + 90, 'y': b}] WHEN form = 3 THEN [{'x': a, 'y': 1440}] ELSE [{'x': a, 'y': b}] END) AS s, form = 3 AS e
 FROM f, (SELECT unnest(range(7)) AS d) WHERE CASE form WHEN 0 THEN d < 5 WHEN 1 THEN d <> 2 WHEN 2 THEN d < 6 WHEN 3 THEN d IN (4, 5, 6, 0) WHEN 4 THEN true WHEN 6 THEN d >= 5 ELSE false END),
held AS (SELECT DISTINCT id, (d * 1440 + m) % 10080 AS m FROM (SELECT id, d, unnest(range(s.x, s.y)) AS m FROM spans)),
unsure AS (SELECT DISTINCT id, (d * 1440 + m) % 10080 AS m FROM (SELECT id, d + 1 AS d, unnest(range(0, CASE WHEN d = 0 THEN 1440 ELSE s.x END)) AS m FROM spans WHERE e)),
now AS (SELECT f.*, CASE WHEN form = 5 THEN 'unknown' WHEN h.m IS NOT NULL THEN 'open' WHEN u.m IS NOT NULL THEN 'unknown' ELSE 'closed' END AS state FROM f LEFT JOIN held h ON h.id = f.id AND h.m = moment LEFT JOIN unsure u ON u.id = f.id AND u.m = moment)"""


def _timed(spark, sf):
    """(id, c_nationkey, moment, line) of customers: hours as maps and guides write them, read into timelines."""
    key = F.col("c_custkey")
    clock = lambda m: F.format_string("%02d:%02d", F.floor(m / 60) % 24, m % 60)
    half = lambda m: F.concat((F.floor(m / 60) + 11) % 12 + 1, F.when(m % 60 > 0, F.format_string(":%02d", m % 60)).otherwise(""), F.when(F.floor(m / 60) % 24 < 12, "AM").otherwise(" pm"))
    a, b = F.col("a"), F.col("b")
    forms = (
        ("Mo-Fr ", clock(a), "-", clock(b)), (clock(a), "-", clock(b), "; We off"), ("mo-fr ", clock(a), "-", clock(a + 60), ",", clock(a + 90), "-", clock(b), "; PH off; Sa ", clock(a), " - ", clock(b)),
        ("Fr-Mo ", clock(a), "+"), ("Daily ", half(a), "-", half(b)), ("by appointment",), ("Saturdays Sundays ", clock(a), "-", clock(a + 60), " and ", clock(a + 90), "-", clock(b)),
    )
    texts = F.array(*(F.concat(*(F.lit(x) if isinstance(x, str) else x for x in form)) for form in forms))
    rows = dealt(table(spark, sf, "customer").select("c_custkey", "c_nationkey")).select(key.alias("id"), "c_nationkey", (key % 7).cast("int").alias("form"), (360 + key * 37 % 300).cast("int").alias("a"), (480 + key * 37 % 300 + key * 53 % 900).cast("int").alias("b"), (key * 797 % 10080).cast("int").alias("moment"))
    return rows.withColumn("line", hours.read(hours.guide(F.get(texts, "form"))))


@query(f"""WITH {_HOURS}, closing AS (SELECT f.id, coalesce(min(CASE WHEN moment // 1440 = d THEN CASE WHEN e OR s.y >= 1440 THEN -1 ELSE s.y END END), min(CASE WHEN moment // 1440 <> d THEN s.y - 1440 END)) AS c FROM f JOIN spans ON spans.id = f.id AND (moment // 1440 = d AND moment % 1440 >= s.x AND moment % 1440 < s.y OR moment // 1440 = (d + 1) % 7 AND moment % 1440 < s.y - 1440) GROUP BY f.id)
SELECT id, moment, state, CASE WHEN c >= 0 THEN c END AS closes FROM now LEFT JOIN closing USING (id)""")
def opening_status(spark, sf):
    """Whether each listing is open at a minute of the week, and when it closes."""
    at = F.col("moment")
    return _timed(spark, sf).select("id", "moment", hours.state(F.col("line"), at).alias("state"), hours.until(F.col("line"), at).alias("closes"))


@query(f"WITH {_HOURS} SELECT c_nationkey, id, state, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE state WHEN 'open' THEN 0 WHEN 'unknown' THEN 1 ELSE 2 END, id) AS place FROM now QUALIFY place <= 20")
def open_now_rank(spark, sf):
    """The first 20 listings of each nation: open ones before those nobody knows of, closed ones last."""
    rows = _timed(spark, sf).select("c_nationkey", "id", hours.state(F.col("line"), F.col("moment")).alias("state"))
    return rows.withColumn("place", F.row_number().over(W.partitionBy("c_nationkey").orderBy(hours.rank(F.col("state")), "id"))).where("place <= 20")


_PARTS = ", ".join(f"('{name}', {a}, {b})" for name, (a, b) in hours.PARTS.items())


@query(f"""WITH {_HOURS}, asked AS (SELECT id, form, d, part, d * 1440 + a0 AS a, d * 1440 + b0 AS b FROM f, (SELECT unnest([0, 5, 6]) AS d), (VALUES {_PARTS}) p(part, a0, b0)),
opened AS (SELECT q.id, d, part, count(*) AS n FROM asked q JOIN held h ON h.id = q.id AND h.m >= a AND h.m < b GROUP BY ALL), doubted AS (SELECT DISTINCT q.id, d, part FROM asked q JOIN unsure u ON u.id = q.id AND u.m >= a AND u.m < b)
SELECT id, d AS day, part, CASE WHEN form = 5 THEN 'unknown' WHEN n > 0 THEN 'open' WHEN x.id IS NOT NULL THEN 'unknown' ELSE 'closed' END AS state, CASE WHEN form <> 5 THEN coalesce(n, 0) END AS minutes FROM asked LEFT JOIN opened USING (id, d, part) LEFT JOIN doubted x USING (id, d, part)""")
def open_in_parts_of_days(spark, sf):
    """Of a Monday, a Saturday and a Sunday, each part of the day: whether a listing opens in it, and for how many minutes."""
    asked = [F.struct(F.lit(d).alias("day"), F.lit(part).alias("part"), F.lit(d * hours.DAY + a).alias("a"), F.lit(d * hours.DAY + b).alias("b")) for d in (0, 5, 6) for part, (a, b) in hours.PARTS.items()]
    rows = _timed(spark, sf).select("id", "line", F.explode(F.array(*asked)).alias("q"))
    return rows.select("id", "q.day", "q.part", hours.during(F.col("line"), F.col("q.a"), F.col("q.b")).alias("state"), hours.minutes(F.col("line")["open"], F.col("q.a"), F.col("q.b")).alias("minutes"))


_W = "regexp_replace(string_split_regex(text, '\\s+')[{n}], '[^\\p{{L}}]', '', 'g')"


@query(f"""WITH p AS (SELECT doc_id, {_W.format(n=1)} AS a, {_W.format(n=2)} AS b FROM documents), s AS (SELECT doc_id, unnest([0, 2, 3]) AS n, a, b FROM p WHERE a <> '' AND b <> '')
SELECT 'guide-' || doc_id || '-' || lpad(n::VARCHAR, 4, '0') AS document_id, a || ' — ' || CASE n WHEN 0 THEN 'Overview' WHEN 2 THEN 'Buy > Money' ELSE 'Get in' END AS title,
 CASE n WHEN 0 THEN 'Lead of ' || a || ' with EUR ' || doc_id || ' and ' || doc_id || ' km on.' WHEN 2 THEN 'Warning: ' || b || '. ' || a || ' is 1/' || (doc_id % 7 + 2) || ' off' ELSE '- ' || a || ': ' || b || chr(10) || chr(10) || '- by ' || doc_id || ' km' END AS text FROM s""")
def guide_sections(spark, sf):
    """Sections of guides in wikitext made of each document's words, with templates in templates."""
    x = F.split("text", r"\s+", 3)  # the rest of a text stays one piece
    word = lambda n: F.regexp_replace(F.get(x, F.lit(n)), r"[^\p{L}]", "")
    rows = table(spark, sf, "documents").select("doc_id", word(0).alias("a"), word(1).alias("b")).where("a != '' and b != ''")
    i, d = F.col("doc_id").cast("string"), (F.col("doc_id") % 7 + 2).cast("string")
    said = (
        "Lead of '''", "a", "''' with {{EUR|", i, "}} and {{nowrap|{{km|", i, "}} on}}.{{pad|{{c|3}}}}\n== Buy ==\n{{see|name=", "b", "|content=costs {{USD|", i, "}}}}\n=== Money ===\n{{warningbox|", "a", " is {{frac|1|", d, "}} off|boldtext=",
        "b", "}} <!-- ", "a", " -->\n== Get in ==\n{{buy|name=", "a", "|alt=[[", "a", "|", "b", "]]}}\n* by {{convert|", i, "|km}}<ref>", "b", "</ref>\n",
    )
    text = F.concat(*(x if not isinstance(x, str) else F.col(x) if x in ("a", "b") else F.lit(x) for x in said))
    return guides.documents(rows.select(F.col("doc_id").alias("page_id"), F.col("a").alias("title"), text.alias("text")), least=10)
