"""Destinations that questions name, as titles of listings spell them: "Cape Town — Swimming", "Mexico City/Centro — Street food".

Phrases that may be names are listed for each question, with their places; titles give a dictionary of names; both meet on the folded phrase. What is confirmed is thinned within stretches of overlapping phrases, longest first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import text as T

WORD = regex.compile(r"[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*")
BREAK = regex.compile(r"[,;:.?!()\[\]\"“”\n]+")
# Fixed values.
BEFORE = frozenset(("in", "at", "near", "around"))
JOINERS = frozenset("of de del della la le les da do dos das am an im upon on the sur and y e".split())
OPENERS = frozenset(
    "best good great top any which where what when who how is are can could should would do does did please tell give show help need want looking find recommend suggest first nice going heading visiting planning there we my our "
    "the a an i im anyone got cheap quick name list ok okay hey hi".split()
)
MOST, STRETCH = 4, 6
#: A run of capitalised words (C, or D for capitalised joiners) and joiners between them (j) ends in a C.
_RUN = regex.compile(rf"[CD][CDj]{{0,{STRETCH - 2}}}C|C")
#: Words (w) after a preposition (p), up to another preposition or a word that names nothing (b).
_AFTER = regex.compile(rf"(?<=p)w{{1,{MOST}}}")


def _empty(low: str) -> bool:
    return len(low) < 2 or low in T.STOPWORDS


def spans(question: str) -> Iterator[tuple[int, int, str]]:
    """(start, length, phrase) of each phrase of one to four words that may name a destination, in words from 0.

    Phrases lie in capitalised runs, whose inner words may be joiners, or after a preposition; they neither begin nor end with a joiner and hold more than filler. A single word that opens the question names nothing. Work grows with the question's length.
    """
    at, seen = 0, set()
    for clause in BREAK.split(question):
        words = WORD.findall(clause)
        low = [w.lower() for w in words]
        shapes = "".join(("D" if v in JOINERS else "C") if w[0].isupper() else "j" if v in JOINERS else "." for w, v in zip(words, low, strict=True))
        roles = "".join("p" if v in BEFORE else "b" if v in OPENERS or _empty(v) else "w" for v in low)
        found = [m.span() for m in _RUN.finditer(shapes)]
        if at == 0 and found and found[0] == (0, 1) and low[0] in OPENERS:
            del found[0]
        for a, z in found + [m.span() for m in _AFTER.finditer(roles)]:
            for start in range(a, z):
                for end in range(start + 1, min(z, start + MOST) + 1):
                    inner = low[start:end]
                    if inner[0] in JOINERS or inner[-1] in JOINERS or all(v in JOINERS or _empty(v) for v in inner) or (start, end, at) in seen:
                        continue
                    seen.add((start, end, at))
                    yield at + start, end - start, " ".join(words[start:end])
        at += len(words)


def phrases(questions: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, start, length, phrase, key): a row for each phrase of each question; key is the folded phrase. Null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, *s) for i, q in enumerate(b.column(len(keys)).to_pylist()) if q for s in spans(q)]
            of, start, length, phrase = zip(*rows, strict=True) if rows else ((), (), (), ())
            own = b.take(pa.array(of, pa.int32()))
            columns = [own.column(i) for i in range(len(keys))] + [pa.array(start, pa.int32()), pa.array(length, pa.int32()), pa.array(phrase, pa.string()), pa.array([T.bare(p) for p in phrase], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*keys, "start", "length", "phrase", "key"])

    given = questions.select(*keys, F.col(text).alias("_text"))
    kinds = ", ".join(f"`{k}` {questions.schema[k].dataType.simpleString()}" for k in keys)
    return given.mapInArrow(run, f"{kinds}, start int, length int, phrase string, key string")


def names(titles: DataFrame, title: str = "title") -> DataFrame:
    """titles with key, a row for each destination or district that the title lists something of: what stands before " — ", and before each "/" of that. Titles without either list nothing."""
    folded = T.unmarked(F.col(title))
    head, listed = F.substring_index("_folded", " — ", 1), F.contains("_folded", F.lit(" — "))
    parts = F.split(head, "/")
    upto = F.size(parts) - F.when(listed, 0).otherwise(1)
    keys = F.when(upto > 0, F.transform(F.sequence(F.lit(1), upto), lambda n: F.array_join(F.slice(parts, 1, n), "/")))
    return titles.withColumn("_folded", folded).withColumn("key", F.explode(keys)).drop("_folded").where("key != ''")


def resolve(questions: DataFrame, titles: DataFrame, keys: list[str], text: str = "text", title: str = "title") -> DataFrame:
    """(keys, destination, key, place): the destinations of titles that each question names, longest first, then in the order of the question. A word belongs to one destination; one that is named again counts once."""
    known = names(titles, title).select(F.col("key").alias("_key")).distinct()
    held = phrases(questions, keys, text).join(known, F.col("key") == F.col("_key")).withColumn("end", F.col("start") + F.col("length"))
    before = F.max("end").over(W.partitionBy(*keys).orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1))
    held = held.withColumn("_new", F.when(F.col("start") < before, 0).otherwise(1))
    held = held.withColumn("_stretch", F.sum("_new").over(W.partitionBy(*keys).orderBy("start", "end").rowsBetween(W.unboundedPreceding, 0)))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("length")).alias("less"), "start", "end", "phrase", "key")))
    kind = "array<struct<less: int, start: int, end: int, phrase: string, key: string>>"
    free = lambda taken, x: ~F.exists(taken, lambda t: (t["start"] < x["end"]) & (x["start"] < t["end"]))
    kept = F.aggregate(ranked, F.array().cast(kind), lambda taken, x: F.when(free(taken, x), F.array_append(taken, x)).otherwise(taken))
    kept = held.groupBy(*keys, "_stretch").agg(kept.alias("kept")).select(*keys, F.explode("kept").alias("k"))
    once = kept.groupBy(*keys, F.lower("k.phrase").alias("_low")).agg(F.min("k").alias("k"))
    place = F.row_number().over(W.partitionBy(*keys).orderBy("k.less", "k.start"))
    return once.select(*keys, F.col("k.phrase").alias("destination"), F.col("k.key").alias("key"), place.alias("place"))


def scoped(resolved: DataFrame, titles: DataFrame, title: str = "title") -> DataFrame:
    """resolved joined with the titles in scope of each destination: its own listings and those of its districts."""
    return resolved.join(names(titles, title).withColumnRenamed("key", "_key"), F.col("key") == F.col("_key")).drop("_key")
