"""Queries on answers: what they work out."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import calculators, maths, steps
from siltstone.functions.text import tokens
from siltstone.operators import rules
from siltstone.plans.base import registry
from siltstone.sources.tables import dealt, table

QUERIES, ORACLES, query = registry()

#: Three steps for each order: a product, a sum that starts from it, and a time of arrival; d cents and e minutes are what they are off by.
_STEPS = """o AS (SELECT o_orderkey AS k, o_custkey % 50 + 1 AS q, o_orderkey % 900 + 100 AS c, CASE WHEN o_orderkey % 3 = 0 THEN 100 ELSE 0 END AS d, 1 + o_custkey % 9 AS h, o_orderkey % 59 + 1 AS m, CASE WHEN o_orderkey % 2 = 0 THEN 10 ELSE 0 END AS e FROM orders),
t AS (SELECT *, printf('%.2f', c / 100.0) AS price, printf('%.2f', (q * c + d) / 100.0) AS made, printf('%.2f', q * c / 100.0) AS true_, printf('%.2f', (q * c + d + 37) / 100.0) AS sum_, printf('%.2f', (q * c + 37) / 100.0) AS true_sum, (495 + h * 60 + m) % 1440 AS mins FROM o),
s AS (SELECT *, printf('%02d:%02d', mins // 60, mins % 60) AS clock, printf('%02d:%02d', (mins + e) % 1440 // 60, (mins + e) % 60) AS told FROM t)"""


def _texts(spark, sf):
    o = dealt(table(spark, sf, "orders").select("o_orderkey", "o_custkey"))
    k, cust = F.col("o_orderkey"), F.col("o_custkey")
    rows = o.select(k.alias("k"), (cust % 50 + 1).alias("q"), (k % 900 + 100).alias("c"), F.when(k % 3 == 0, 100).otherwise(0).alias("d"), (1 + cust % 9).alias("h"), (k % 59 + 1).alias("m"), F.when(k % 2 == 0, 10).otherwise(0).alias("e"))
    money = lambda cents: F.format_string("€%.2f", cents / 100)
    at = (495 + F.col("h") * 60 + F.col("m") + F.col("e")) % 1440
    made = F.col("q") * F.col("c") + F.col("d")
    lines = F.concat_ws(
        "", F.lit("So "), "q", F.lit(" boxes × "), money(F.col("c")), F.lit(" = "), money(made), F.lit(".\nThen "), money(made), F.lit(" + €0.37 = "), money(made + 37), F.lit("; not 2 × 3 × 4 = 25.\nArrival: 08:15 + "), "h", F.lit(" h "), "m", F.lit(" min = "), F.format_string("%02d:%02d", F.floor(at / 60), at % 60), F.lit("."),
    )
    return rows.select("k", lines.alias("text"))


@query(f"""WITH {_STEPS} SELECT k, 1 AS n, round(q * c / 100.0, 4)::DOUBLE AS value, d = 0 AS is_right, q || ' boxes × €' || price || ' = €' || true_ AS fixed FROM s
UNION ALL SELECT k, 2, round((q * c + 37) / 100.0, 4)::DOUBLE, d = 0, '€' || true_ || ' + €0.37 = €' || true_sum FROM s UNION ALL SELECT k, 3, mins::DOUBLE, e = 0, '08:15 + ' || h || ' h ' || m || ' min = ' || clock FROM s""")
def worked_steps(spark, sf):
    """Each step of generated answers worked out again."""
    found = steps.listed(_texts(spark, sf), "k", "text")
    return found.select("k", "n", F.round("value", 4).alias("value"), F.col("right").alias("is_right"), "fixed")


@query(f"""WITH {_STEPS} SELECT k, 'So ' || q || ' boxes × €' || price || ' = €' || true_ || CASE WHEN d > 0 THEN ' (corrected)' ELSE '' END || '.' || chr(10) || 'Then €' || true_ || ' + €0.37 = €' || true_sum || CASE WHEN d > 0 THEN ' (corrected)' ELSE '' END || '; not 2 × 3 × 4 = 25.' || chr(10) || 'Arrival: 08:15 + ' || h || ' h ' || m || ' min = ' || clock || CASE WHEN e > 0 THEN ' (corrected)' ELSE '' END || '.' AS text FROM s""")
def corrected_answers(spark, sf):
    """Generated answers with their wrong steps put right."""
    found = _texts(spark, sf).withColumn("steps", steps.steps(F.col("text")))
    return found.select("k", steps.corrected(F.col("text"), F.col("steps")).alias("text"))


@query("SELECT p_partkey, 'Cost ' || p_partkey || '/' || p_size || ' of CO₂ × 10' || translate((p_partkey % 100)::VARCHAR, '0123456789', '⁰¹²³⁴⁵⁶⁷⁸⁹') || ', √(' || p_size || ' + x₁), $5 or $' || p_size AS text, '\\frac{' || p_partkey || '}{' || p_size || '}\\times {x}^{' || p_size || '}' AS latex FROM part")
def mathematics_shown(spark, sf):
    """LaTeX of each part as characters, and MathML as LaTeX."""
    k, n = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    text = F.concat(F.lit("Cost $\\frac{"), k, F.lit("}{"), n, F.lit("}$ of CO_2 $\\times 10^{"), (F.col("p_partkey") % 100).cast("string"), F.lit("}$, \\(\\sqrt{"), n, F.lit(" + x_1}\\), $5 or $"), n)
    markup = F.concat(F.lit("<math><mfrac><mn>"), k, F.lit("</mn><mn>"), n, F.lit("</mn></mfrac><mo>×</mo><mspace/><msup><mi>x</mi><mn>"), n, F.lit("</mn></msup></math>"))
    return table(spark, sf, "part").select("p_partkey", maths.readable(text).alias("text"), maths.from_mathml(markup).alias("latex"))


ZONES = ("Europe/Paris", "America/New_York", "Asia/Kolkata", "Pacific/Auckland")


@query(f"""WITH e AS (SELECT event_id, ts::TIMESTAMP AS ts, timezone(({list(ZONES)})[event_id % 4 + 1], timezone('UTC', ts::TIMESTAMP)) AS local FROM events)
SELECT event_id, strftime(local, '%Y-%m-%d') AS day, (hour(local) * 60 + minute(local))::INT AS minute, round(epoch(local - ts) / 60)::INT AS ahead FROM e""")
def zone_clocks(spark, sf):
    """What the clocks of four zones show at each event."""
    zone = F.element_at(F.array(*map(F.lit, ZONES)), (F.col("event_id") % 4 + 1).cast("int"))
    rows = table(spark, sf, "events").select("event_id", calculators.zone_clock(F.col("ts").cast("timestamp"), zone).alias("c"))
    return rows.select("event_id", F.col("c.day").cast("string").alias("day"), "c.minute", "c.ahead")


RULES = (
    rules.Rule("numbers", all=(r"\d{3}",), none=("the",)), rules.Rule("greeting", any=("^in ", "^the "), none=(r"\?",)), rules.Rule("both", all=("un", "an"), any=("ou", "ch")), rules.Rule("rest", all=("e",)),
)


@query(r"""SELECT conv_id, turn, CASE WHEN regexp_matches(t, '\d{3}') AND NOT contains(t, 'the') THEN 'numbers' WHEN (starts_with(t, 'in ') OR starts_with(t, 'the ')) AND NOT contains(t, '?') THEN 'greeting' WHEN contains(t, 'un') AND contains(t, 'an') AND (contains(t, 'ou') OR contains(t, 'ch')) THEN 'both' WHEN contains(t, 'e') THEN 'rest' END AS rule
FROM (SELECT conv_id, turn, lower(text) AS t FROM conversations)""")
def first_rules(spark, sf):
    """The first of four ordered rules that each turn fits."""
    return table(spark, sf, "conversations").select("conv_id", "turn", rules.named(F.col("text"), RULES).alias("rule"))


@query(r"""SELECT doc_id, 'guide' || k AS name, count(*) AS hits FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) AS w FROM documents) JOIN (SELECT DISTINCT item_id % 7 AS k, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM benchmark) USING (w) GROUP BY doc_id, k""")
def guides_by_keywords(spark, sf):
    """How many keywords of each of seven guides every document holds."""
    keywords = table(spark, sf, "benchmark").select(F.concat(F.lit("guide"), F.col("item_id") % 7).alias("name"), F.explode(tokens(F.col("text"))).alias("word"))
    return rules.ranked(table(spark, sf, "documents").select("doc_id", tokens(F.col("text")).alias("w")), keywords, "w", "doc_id")
