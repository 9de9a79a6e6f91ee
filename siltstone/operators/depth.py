"""More of the articles that questions are about: which passages of each fit the question, and how many of them a reading budget holds.

Everything is keyed by the question. Passages are scored and put in order by windows; the choice under the budget is a fold over sizes alone, at most a few hundred for each question, and texts join what was chosen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions.text import query_terms, tokens
from siltstone.operators.coverage import found

# What a question asks by, and the headings that answer it; a star leaves a word's end open.
KINDS = (
    ("why, caus*, led to, happen*", "cause, causes, reason, reasons, background, origin, origins, mechanism, mechanisms"),
    ("how does, how do, how is, how are, how can, work*", "operation, principle, principles, mechanism, mechanisms, function, functioning, theory, design, physics, process, features, structure, characteristics"),
    ("differ*, compar*, versus, vs, which, better", "comparison, type, types, classification, difference, differences, definition, definitions, terminology, naming, nomenclature"),
    ("advantage*, drawback*, disadvantage*, benefit*, risk, risks, limitation*, pros, cons", "advantage, advantages, disadvantage, disadvantages, drawbacks, benefit, benefits, limitation, limitations, criticism, risk, risks, safety"),
    ("symptom*, sign, signs", "signs and symptoms, symptoms, diagnosis"),
    ("treat*, cure*, manag*", "treatment, management, therapy, prevention"),
    ("effect, effects, health, evidence, research", "effect, effects, health, research, evidence, safety"),
    ("shape*, trade, rise", "history, background, cause, causes, trade, economy, legacy, impact, consequences"),
    ("collapse*, decline*, fall, fell, dissol*, end, ended, surviv*", "dissolution, fall, decline, collapse, disintegration, breakup, end, history, background, cause, causes, legacy, consequences"),
    ("change*, society, social, affect*, impact*, influence*", "legacy, impact, consequences, effect, effects, influence, society, social, economic, economy, history"),
    ("cry, cries, tear, tears, sting*, itch*, burn*, hurt*, pain*, harm*, poison*, toxic*, allerg*", "irritation, adverse effect, adverse effects, toxicity, side effect, side effects, safety, poisoning, allerg*, health"),
    ("salt*, salin*", "salinity, composition, chemistry, salt"),
    ("happen*, shrink*, shrank*, story, deal with, come back, recover*", "history, background, impact, consequences, solution, solutions, recovery, restoration, current situation"),
    ("fee, fees, cost*, price*, cheap*, expensive*", "economic, economics, fee, fees, gas, transaction fee, transaction fees, market, trade, production, cultivation, pricing"),
    ("evidence, study, studies, research, risk, risks, good for, health*", "health effect, health effects, effect, effects, research, safety"),
    ("phase, phases", "phase, phases"),
)
QUESTION_WORDS = tuple("how why what does do did is are was were can the difference between and when should use each my for of in on whats actual real which better i you we them it".split())
OVERLAP, LEAST_CUT, MOST_ROWS = 150, 240, 200


def _any_of(words: str) -> str:
    return r"(?i)\b(?:" + "|".join(w[:-1] + r"\w*" if w.endswith("*") else w + r"\b" for w in words.split(", ")) + ")"


def budget(speed: Column, seconds: float = 20.0, least: int = 1000, most: int = 3600, unknown: int = 2000) -> Column:
    """Characters that a reader of so many tokens a second takes in `seconds`, four to a token; `unknown` where the speed isn't known."""
    known = speed.isNotNull() & (speed > 0) & (speed < float("inf"))
    return F.when(known, F.greatest(F.lit(least), F.least(F.lit(most), F.floor(speed * seconds * 4)))).otherwise(unknown).cast("int")


def heading_points(question: Column, heading: Column) -> Column:
    """3 if the last part of a heading answers the kind of the question, 2 if one above it does, else 0."""
    own = F.substring_index(heading, " > ", -1)
    parts = F.split(heading, " > ")
    above = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), " > ")
    fits = lambda part: [question.rlike(_any_of(asks)) & part.rlike(_any_of(heads)) for asks, heads in KINDS]
    some = lambda tests: F.exists(F.array(*tests), lambda t: t)
    return F.when(some(fits(own)), 3).when(some(fits(above)), 2).otherwise(0)


def bibliography(text: Column) -> Column:
    """Whether a passage is a list of citations: three marks of such or more."""
    marks = r"(?i)\bdoi\s*:\s*10\.|\bPMID\s+\d|\bPMC\s+\d|\bS2CID\s+\d|\{\{cite journal|CS1 maint:"
    return F.size(F.regexp_extract_all(text, F.lit(marks), F.lit(0))) >= 3


def ranked(passages: DataFrame, subjects: DataFrame, by: str, most: int = MOST_ROWS) -> DataFrame:
    """Passages in reading order for each question and article: (by, slot, share, article, doc, n, lead, size, score, place).

    passages: article, doc (a section), n (its piece, from 0), lead (whether the section opens the article), heading, text. subjects: by, question, article, slot, share (characters). The opening piece comes first, then sections that score, best first and each in its own order, the rest of the lead, and what doesn't score. Where the opening piece and the best section together exceed the share, the section goes before it. The first `most` pieces of an article are read; lists of citations are left out.
    """
    first = F.row_number().over(W.partitionBy("article").orderBy(F.desc("lead"), "doc", "n"))
    read = passages.where(F.col("text").isNotNull()).withColumn("_row", first).where(F.col("_row") <= most).drop("_row").where(~bibliography(F.col("text")))
    s = subjects.select(by, "question", F.col("article").alias("_article"), "slot", "share")
    rows = read.join(s, F.col("article") == F.col("_article")).drop("_article")
    own = tokens(F.col("article"))
    terms = F.filter(query_terms(F.col("question")), lambda t: ~t.isin(*QUESTION_WORDS) & ~F.array_contains(own, t))
    score = heading_points(F.col("question"), F.col("heading")) + 2 * found(tokens(F.col("heading")), terms) + found(F.array_distinct(tokens(F.col("text"))), terms)
    rows = rows.select(by, "slot", "share", "article", "doc", "n", "lead", F.length("text").alias("size"), score.alias("score"))
    section = W.partitionBy(by, "slot", "doc")
    article = W.partitionBy(by, "slot")
    rows = rows.withColumn("_best", F.max("score").over(section)).withColumn("_opens", F.col("lead") & (F.row_number().over(W.partitionBy(by, "slot", "lead").orderBy("doc", "n")) == 1))
    scores = ~F.col("lead") & (F.col("_best") > 0)
    head = F.max(F.when(F.col("_opens"), F.col("size"))).over(article)
    top = F.min(F.when(scores, F.struct((-F.col("_best")).alias("b"), "doc", "n", "size"))).over(article)["size"]
    rows = rows.withColumn("_late", F.coalesce(head + top > F.col("share"), F.lit(False)))
    group = F.when(F.col("_opens"), F.when(F.col("_late"), 2).otherwise(0)).when(scores, 1).when(F.col("lead"), 3).otherwise(4)
    order = ["_group", F.when(F.col("lead"), 0).otherwise(-F.col("_best")), "doc", "n"]
    rows = rows.withColumn("_group", group).withColumn("place", F.row_number().over(article.orderBy(*order)))
    return rows.select(by, "slot", "share", "article", "doc", "n", "lead", (F.col("_opens")).alias("opens"), "size", "score", "place")


def _taken(item: Column, size: Column) -> Column:
    return F.struct(item["slot"].alias("slot"), item["doc"].alias("doc"), item["n"].alias("n"), size.cast("int").alias("size"))


def pick(rows: DataFrame, passages: DataFrame, by: str, chars: int) -> DataFrame:
    """(by, doc, n, size, turn): the pieces that `chars` characters hold, subjects taking turns.

    rows: ranked(). A piece costs its length, less the overlap if the piece before it is taken. One that exceeds what is left of its subject's share waits, and is taken at the end if it fits what all have left; an article's opening piece is cut instead, at the last sentence that fits, unless fewer than 240 characters would stay.
    """
    ends = F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("text") - 1)), lambda i: F.substring(F.col("text"), i, F.lit(2)).rlike(r"^[.!?]\s$")), lambda i: i.cast("int"))
    opening = rows.where("opens").select("doc", "n").distinct()
    cuts = passages.join(opening, ["doc", "n"]).select(F.col("doc").alias("_doc"), F.col("n").alias("_n"), ends.alias("_ends"))
    rows = rows.join(cuts, (F.col("doc") == F.col("_doc")) & (F.col("n") == F.col("_n")), "left")
    kind = rows.schema["doc"].dataType.simpleString()
    item = f"struct<place: int, slot: int, doc: {kind}, n: int, size: int, opens: boolean, ends: array<int>>"
    queue = F.array_sort(F.collect_list(F.struct("place", "slot", "doc", "n", "size", "opens", F.col("_ends").alias("ends")).cast(item)))
    shares = F.map_from_entries(F.collect_set(F.struct("slot", F.col("share").cast("int"))))
    asked = rows.groupBy(by).agg(queue.alias("queue"), shares.alias("left"))
    none = F.array().cast(f"array<struct<slot: int, doc: {kind}, n: int, size: int>>")
    cost = lambda taken, x: x["size"] - F.when(F.exists(taken, lambda t: (t["doc"] == x["doc"]) & (t["n"] + 1 == x["n"])), OVERLAP).otherwise(0)
    spent = lambda left, x, used: F.transform_values(left, lambda k, v: F.when(k == x["slot"], (v - used).cast("int")).otherwise(v))
    state = lambda left, all_, taken, wait: F.struct(left.alias("left"), all_.cast("int").alias("all"), taken.alias("taken"), wait.alias("wait"))

    def step(a: Column, x: Column) -> Column:
        price, room = cost(a["taken"], x), F.element_at(a["left"], x["slot"])
        end = F.array_max(F.filter(x["ends"], lambda e: e <= room))
        cut = F.when(x["opens"] & (end >= LEAST_CUT), end)
        take = lambda size, used: state(spent(a["left"], x, used), a["all"] - used, F.array_append(a["taken"], _taken(x, size)), a["wait"])
        return F.when(price <= room, take(x["size"], price)).when(cut.isNotNull(), take(cut, cut)).otherwise(state(a["left"], a["all"], a["taken"], F.array_append(a["wait"], x)))

    def late(a: Column, x: Column) -> Column:
        price = cost(a["taken"], x)
        return F.when(price <= a["all"], state(a["left"], a["all"] - price, F.array_append(a["taken"], _taken(x, x["size"])), a["wait"])).otherwise(a)

    start = state(F.col("left"), F.lit(chars), none, F.array().cast(f"array<{item}>"))
    turns = asked.select(by, F.aggregate("queue", start, step).alias("s"))
    turns = turns.select(by, F.aggregate("s.wait", F.col("s"), late, lambda a: a["taken"]).alias("taken"))
    return turns.select(by, F.posexplode("taken").alias("turn", "t")).select(by, "t.doc", "t.n", "t.size", "turn")


def joined(picked: DataFrame, passages: DataFrame, by: str) -> DataFrame:
    """(by, place, doc, first, last, text): runs of neighbouring pieces of a section as one text, their overlap told once, sections in the order in which they were first taken."""
    texts = passages.select(F.col("doc").alias("_doc"), F.col("n").alias("_n"), F.col("text").alias("_text"))
    rows = picked.join(texts, (F.col("doc") == F.col("_doc")) & (F.col("n") == F.col("_n"))).withColumn("text", F.left("_text", "size")).drop("_doc", "_n", "_text")
    section = W.partitionBy(by, "doc")
    rows = rows.withColumn("_seen", F.min("turn").over(section)).withColumn("_run", F.col("n") - F.row_number().over(section.orderBy("n")))
    before = F.lag("text").over(W.partitionBy(by, "doc", "_run").orderBy("n"))
    own = F.when(before.isNull(), F.col("text")).when(F.endswith(before, F.left("text", F.lit(OVERLAP))), F.substring(F.col("text"), F.lit(OVERLAP + 1), F.length("text"))).otherwise(F.concat(F.lit(" "), "text"))
    rows = rows.withColumn("_own", own).groupBy(by, "doc", "_run").agg(F.min("_seen").alias("_seen"), F.min("n").alias("first"), F.max("n").alias("last"), F.array_sort(F.collect_list(F.struct("n", "_own"))).alias("_parts"))
    place = F.row_number().over(W.partitionBy(by).orderBy("_seen", "first"))
    return rows.select(by, place.alias("place"), "doc", "first", "last", F.regexp_replace(F.array_join(F.transform("_parts", lambda p: p["_own"]), ""), r"^\s+|\s+$", "").alias("text"))
