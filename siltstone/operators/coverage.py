"""Evidence of several collections for questions of one or more parts: what is relevant, what a part cannot do without, and what covers the whole question.

Questions are a table, so every step is keyed by the question: judged once on each candidate's words, then chosen among the candidates that are left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions.text import query_terms, tokens
from siltstone.operators.merge import merge

_ASKS = r"what|why|how|when|where|which|who"
_QUOTED = r"\"(?:\\.|[^\"\\])*+\"|`(?:\\.|[^`\\])*+`|“(?:\\.|[^”\\])*+”"
_NEXT = rf"(?i)(?:,?\s+and\s+|[?;]\s+)(?=(?:{_ASKS})\b)"


def clauses(question: Column, longest: int = 2000, nested: int = 4) -> Column:
    """The two or three questions that one is made of ("What is a fjord and how does it form?"), or none.

    It must begin with a question word; parts begin with one too, after "and" or a mark, and hold two terms or more. Quoted and bracketed text is blanked first; where quotes or brackets don't close, brackets lie deeper than `nested`, or the question is longer than `longest`, there are no parts.
    """
    bare = F.regexp_replace(question, _QUOTED, " ")
    for _ in range(nested):
        bare = F.regexp_replace(bare, r"\([^()]*\)", " ")
    whole = ~bare.rlike("[\"`“()]") & bare.rlike(rf"(?i)^\s*(?:{_ASKS}|explain|describe|compare)\b") & (F.length(question) <= longest)
    parts = F.transform(F.split(F.regexp_replace(bare, _NEXT, "\u0001"), "\u0001"), lambda p: F.trim(p))
    good = whole & F.size(parts).between(2, 3) & F.forall(parts, lambda p: F.size(query_terms(p)) >= 2)
    return F.when(good, parts).otherwise(F.array().cast("array<string>"))


def found(words: Column, terms: Column) -> Column:
    """How many of an array of terms an array of words holds; a term of four letters or more also as the beginning of a word."""
    return F.size(F.filter(terms, lambda t: F.array_contains(words, t) | (_begins(t) & F.exists(words, lambda w: F.startswith(w, t)))))


def _begins(term: Column) -> Column:
    """Whether a term is found as the beginning of a word too."""
    return (F.length(term) >= 4) & term.rlike(r"^\p{L}+$")


def telling(words: DataFrame, terms: DataFrame, word: str = "word", term: str = "term") -> DataFrame:
    """Rows of words whose word some term is found by, see found(): all that judging needs of a text. They meet under four letters, so each word meets few terms."""
    t = terms.select(F.col(term).alias("_t")).distinct().select("_t", F.left("_t", F.lit(4)).alias("_four"), _begins(F.col("_t")).alias("_open"))
    fits = (F.col(word) == F.col("_t")) | (F.col("_open") & F.startswith(F.col(word), F.col("_t")))
    return words.join(t, (F.left(F.col(word), F.lit(4)) == F.col("_four")) & fits, "left_semi")


def required(terms: Column) -> Column:
    """Hits that a passage needs: one of up to two terms, two of up to five, three of more."""
    n = F.size(terms)
    return F.when(n <= 2, 1).when(n <= 5, 2).otherwise(3)


def judged(candidates: DataFrame, questions: DataFrame, by: str, question: str = "question", text: str = "text", document: str = "doc_id", words: str | None = None) -> DataFrame:
    """candidates with parts (for each clause of their question, whether the passage serves it), eligible, covers (it holds every one of two terms or more) and clauses (how many the question has).

    A passage serves a clause if it has the hits the clause needs. A later clause may lean on the first ("how does it form"): its passages must belong to a document that serves the first or name something of the first, unless the clause asks "what is" or "how does" without a pronoun. Without clauses the question as a whole decides. Null texts serve nothing. words: a column with the text's words, or those of them that are telling(), which stands for the text where passages meet many questions.
    """
    own = questions.select(F.col(by).alias("_by"), query_terms(F.col(question)).alias("_terms"), clauses(F.col(question)).alias("_clauses"))
    own = own.select("_by", "_terms", F.transform("_clauses", lambda c: F.struct(query_terms(c).alias("terms"), (c.rlike(r"(?i)^\s*(?:what\s+(?:is|are)|(?:how|why)\s+(?:does|do))\s+") & ~c.rlike(r"(?i)\b(?:it|its|they|their|them|this|that|these|those|former|latter)\b")).alias("alone"))).alias("_clauses"))
    rows = candidates.join(own, F.col(by) == F.col("_by")).withColumn("_words", F.array_distinct(tokens(F.coalesce(F.col(text), F.lit("")))) if words is None else F.col(words))
    hits = F.transform("_clauses", lambda c: found(F.col("_words"), c["terms"]))
    rows = rows.withColumns({"_hits": hits, "_n": found(F.col("_words"), F.col("_terms"))}).drop("_words")  # no words cross the window
    rows = rows.withColumn("_serves", F.zip_with("_clauses", "_hits", lambda c, n: n >= required(c["terms"])))
    led = F.max(F.coalesce(F.get("_serves", F.lit(0)), F.lit(False))).over(W.partitionBy(by, document))
    rows = rows.withColumn("_led", led | (F.coalesce(F.get("_hits", F.lit(0)), F.lit(0)) > 0))
    parts = F.transform("_serves", lambda s, i: s & ((i == 0) | F.col("_led") | F.get("_clauses", i)["alone"]))
    rows = rows.withColumn("parts", parts).withColumn("clauses", F.size("_clauses"))
    rows = rows.withColumn("eligible", F.when(F.col("clauses") > 0, F.exists("parts", lambda p: p)).otherwise(F.col("_n") >= required(F.col("_terms"))))
    return rows.withColumn("covers", (F.size("_terms") >= 2) & (F.col("_n") == F.size("_terms"))).drop("_by", "_terms", "_clauses", "_hits", "_serves", "_led", "_n")


def anchors(rows: DataFrame, by: Sequence[str], order: Sequence[Column], key: str = "doc_id") -> DataFrame:
    """(by, key, clause): for each clause one passage that serves it, of those that serve most clauses the first by order; a passage chosen for several clauses counts for its first."""
    served = rows.withColumn("_most", F.size(F.filter("parts", lambda p: p))).select(*by, key, *(o.alias(f"_o{i}") for i, o in enumerate(order)), "_most", F.posexplode("parts").alias("clause", "_serves")).where("_serves")
    first = F.row_number().over(W.partitionBy(*by, "clause").orderBy(F.desc("_most"), *(f"_o{i}" for i in range(len(order))), key))
    return served.withColumn("_n", first).where("_n = 1").groupBy(*by, key).agg(F.min("clause").alias("clause"))


def merge_relevant(rows: DataFrame, limit: int, by: str, keep: int = 50, pack: str = "pack", key: str = "doc_id", focus: Column | None = None) -> DataFrame:
    """(by, pack, key, tier, rank): the `limit` best passages of each question, of judged rows.

    Only eligible passages compete, the `keep` best of each collection (by score). Tier 0: passages in focus (exact conditions), merged by themselves. Tier 1, for questions of several clauses without any in focus: an anchor for each clause. Tier 2: the rest merged, those that cover the whole question leading. A question for which nothing is eligible has no rows.
    """
    rows = rows.where("eligible").withColumn("_focus", F.lit(False) if focus is None else F.coalesce(focus, F.lit(False)))
    rows = rows.withColumn("_place", F.row_number().over(W.partitionBy(by, pack).orderBy(F.desc("_focus"), F.desc("covers"), F.desc("score"), key))).where(F.col("_place") <= keep)
    rows = rows.withColumn("_any", F.max("_focus").over(W.partitionBy(by)))
    front = merge(rows.where("_focus"), limit, keep, pack, key, [by]).select(by, pack, key, F.lit(0).alias("tier"), "rank")
    order = [F.col(pack), -F.col("score")]
    chosen = anchors(rows.where("not _any and clauses > 0"), [by], order, key)
    held = rows.select(by, key, F.struct(pack, (-F.col("score")).alias("s")).alias("_at")).groupBy(by, key).agg(F.min("_at").alias("_at"))
    firm = chosen.join(held, [by, key]).select(by, F.col(f"_at.{pack}").alias(pack), key, F.lit(1).alias("tier"), F.row_number().over(W.partitionBy(by).orderBy("clause")).alias("rank")).where(F.col("rank") <= limit)
    ahead = front.unionByName(firm)
    left = F.lit(limit) - F.coalesce("_taken", F.lit(0))
    rest = rows.where("not _focus").join(ahead.select(by, key), [by, key], "left_anti").join(ahead.groupBy(by).agg(F.count("*").alias("_taken")), by, "left")
    rest = merge(rest.withColumn("_left", left), F.col("_left"), keep, pack, key, [by], F.col("covers")).select(by, pack, key, F.lit(2).alias("tier"), "rank")
    every = ahead.unionByName(rest)
    return every.select(by, pack, key, "tier", F.row_number().over(W.partitionBy(by).orderBy("tier", "rank")).alias("rank"))
