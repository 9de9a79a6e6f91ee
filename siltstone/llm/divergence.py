"""How the sources of each language differ in their words: an audit over all pairs of sources.

A term that neither source of a pair has adds the same to their distance whatever the term, so each pair starts at the number of terms times that baseline. Only what a source has differs from it: the postings of a term (the sources that have it) emit corrections, and a source's own list corrects all pairs it is in. Terms that a pair shares are met in the postings; what one side has alone comes from sums over that side. Everything is whole numbers.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.llm.common import discard, materialise, parts, table

TERM = re.compile(rb"[a-z\x80-\xff]+")
SCALE = 1_000_000_000


def counted(docs: DataFrame, most: int = 200_000) -> DataFrame:
    """(lang, source, term, count, docs): occurrences and documents of each term, summed up within tasks; a row with an empty term stands for the group itself. A task holds `most` entries and one text at a time."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), terms in occurs.items():
                names, seen = list(terms), within[lang, source]
                n = len(names)
                columns = [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(names, pa.binary()).cast(pa.string()), pa.array(list(terms.values()), pa.int64()), pa.array([seen[t] for t in names], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "count", "docs"])

        occurs, within, held = defaultdict(Counter), defaultdict(Counter), 0
        for b in parts(batches, 200):
            for lang, source, text in zip(*(b.column(c).to_pylist() for c in ("lang", "source")), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                terms = TERM.findall(text.lower())  # of bytes, so A-Z only
                own, seen = occurs[lang, source], within[lang, source]
                held -= len(own)
                own[b""] += 0
                own.update(terms)
                seen.update(set(terms))
                held += len(own)
                if held >= most:
                    yield from rows()
                    occurs, within, held = defaultdict(Counter), defaultdict(Counter), 0
        yield from rows()

    given = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    found = given.mapInArrow(count, "lang string, source string, term string, count long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def share(count, n, v):
    """1 + floor(SCALE * (count + 5) / (n + 5 * v)), exactly."""
    whole = lambda c: c.cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", whole(count + 5) * F.lit(SCALE).cast("decimal(10,0)"), whole(n + 5 * v))


def audit(docs: DataFrame, least: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): for each source of a language its distance to each other source (part pair), and its `top` terms that it has more than the language as a whole (part term).

    Null text, lang and source count as ''. A language keeps the terms of `least` documents or more; one that keeps none has distances of 0. Repeated rows are documents of their own; empty texts count for their group alone. A language of one source has no pairs. No documents give no rows. Other columns are ignored. Ranks are from 1, value descending, then item in UTF-8 order.
    """
    counts = materialise(counted(docs), "counts")
    of_lang = counts.where("term != ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("total")).where(F.col("docs") >= least)
    kept = materialise(of_lang.select("lang", "term", "total"), "kept")
    k = kept.select(F.col("lang").alias("_lang"), F.col("term").alias("_term"), "total")
    held = counts.where("term != ''").join(k, (F.col("lang") == F.col("_lang")) & (F.col("term") == F.col("_term"))).select("lang", "source", "term", "count", "total")
    held = materialise(held, "held")
    size = kept.groupBy(F.col("lang").alias("_l")).agg(F.count("*").alias("v"), F.sum("total").alias("all"))
    own = held.groupBy(F.col("lang").alias("_g"), F.col("source").alias("_s")).agg(F.sum("count").alias("n"))
    groups = counts.select("lang", "source").distinct().join(size, F.col("lang") == F.col("_l"), "left").join(own, (F.col("lang") == F.col("_g")) & (F.col("source") == F.col("_s")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    groups = groups.select("lang", "source", zero("v"), zero("all"), zero("n")).withColumn("p0", F.when(F.col("v") > 0, share(F.lit(0).cast("long"), F.col("n"), F.col("v"))).otherwise(0))
    groups = materialise(groups, "groups")
    g = groups.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "v", "all", "n", "p0")
    posted = held.join(g, (F.col("lang") == F.col("_lang")) & (F.col("source") == F.col("_source")))
    posted = materialise(posted.select("lang", "source", "term", "v", "p0", share(F.col("count"), F.col("n"), F.col("v")).alias("p"), share(F.col("total"), F.col("all"), F.col("v")).alias("q")), "postings")
    out = _pairs(groups, posted).unionByName(_terms(posted, top))
    out = materialise(out.select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank")), "audit")
    discard(counts, kept, held, groups, posted)
    return out


def _terms(posted: DataFrame, top: int) -> DataFrame:
    more = posted.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    place = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return more.withColumn("rank", place).where(F.col("rank") <= top)


def _pairs(groups: DataFrame, posted: DataFrame) -> DataFrame:
    side = lambda x: groups.select(F.col("lang").alias(f"{x}_lang"), F.col("source").alias(x), F.col("p0").alias(f"{x}0"), F.col("v").alias(f"{x}_v"))
    pairs = side("a").join(side("b"), (F.col("a_lang") == F.col("b_lang")) & (F.col("a") != F.col("b")))
    pairs = pairs.select(F.col("a_lang").alias("lang"), "a", "b", "a0", "b0", (F.col("a_v") * F.abs(F.col("a0") - F.col("b0"))).alias("base"))
    # what a has, if b had none of it: a's terms by share, as many rows as it has different counts, against the baselines of the other sources
    levels = posted.groupBy("lang", "source", "p0", "p").agg(F.count("*").alias("m"))
    bases = groups.groupBy(F.col("lang").alias("_lang"), F.col("p0").alias("z0")).agg(F.lit(1).alias("_one")).drop("_one")
    alone = levels.join(bases, F.col("lang") == F.col("_lang")).select("lang", "source", "z0", (F.col("m") * (F.abs(F.col("p") - F.col("z0")) - F.abs(F.col("p0") - F.col("z0")))).alias("c")).where("c != 0")
    alone = alone.groupBy(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "z0").agg(F.sum("c").alias("c"))
    # terms that both have, met in the postings
    x, y = (posted.select(F.col("lang").alias(f"{s}_lang"), F.col("term").alias(f"{s}_term"), F.col("source").alias(s), F.col("p").alias(f"{s}_p"), F.col("p0").alias(f"{s}_0")) for s in "xy")
    both = x.join(y, (F.col("x_lang") == F.col("y_lang")) & (F.col("x_term") == F.col("y_term")) & (F.col("x") < F.col("y")))
    fix = F.abs(F.col("x_p") - F.col("y_p")) - F.abs(F.col("x_p") - F.col("y_0")) - F.abs(F.col("y_p") - F.col("x_0")) + F.abs(F.col("x_0") - F.col("y_0"))
    both = both.select("x_lang", "x", "y", fix.alias("c")).where("c != 0").groupBy("x_lang", "x", "y").agg(F.sum("c").alias("c_both"))
    a = alone.select(F.col("_lang").alias("l1"), F.col("_source").alias("s1"), F.col("z0").alias("z1"), F.col("c").alias("c_a"))
    b = alone.select(F.col("_lang").alias("l2"), F.col("_source").alias("s2"), F.col("z0").alias("z2"), F.col("c").alias("c_b"))
    whole = pairs.join(a, (F.col("lang") == F.col("l1")) & (F.col("a") == F.col("s1")) & (F.col("b0") == F.col("z1")), "left")
    whole = whole.join(b, (F.col("lang") == F.col("l2")) & (F.col("b") == F.col("s2")) & (F.col("a0") == F.col("z2")), "left")
    whole = whole.join(both, (F.col("lang") == F.col("x_lang")) & (F.least("a", "b") == F.col("x")) & (F.greatest("a", "b") == F.col("y")), "left")
    value = F.col("base") + F.coalesce("c_a", F.lit(0)) + F.coalesce("c_b", F.lit(0)) + F.coalesce("c_both", F.lit(0))
    whole = whole.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), value.alias("value"))
    return whole.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH docs AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS r FROM documents),
runs AS (SELECT lang, source, r, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS total FROM runs GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS n FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS c FROM runs JOIN kept USING (lang, term) GROUP BY lang, source, term),
groups AS (SELECT DISTINCT lang, source FROM docs),
sizes AS (SELECT lang, source, coalesce(sum(c), 0)::HUGEINT AS n FROM groups LEFT JOIN counts USING (lang, source) GROUP BY lang, source),
shares AS (SELECT s.lang, s.source, k.term, coalesce(c, 0) AS c, 1 + (1000000000 * (coalesce(c, 0) + 5)) // (s.n + 5 * l.v) AS p, 1 + (1000000000 * (k.total + 5)) // (l.n + 5 * l.v) AS q FROM sizes s JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
 UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM shares WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM every QUALIFY part = 'pair' OR rank <= 50
"""
