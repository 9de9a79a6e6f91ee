"""Personal data, and the terms that disclose it, by information-theoretic sanitisation.

Values of four kinds are found by pattern. An entity is a value or the part of it that values share: a mail domain, the first three numbers of an address, a card's issuer, a phone number without its last four digits. A term in an entity's texts discloses it in so far as the corpus says so: the pointwise mutual information of entity and term, PMI = log2(N n(c,t) / (n(c) n(t))), is compared with the entity's own information, IC = log2(N / n(c)). A term with PMI of `share` times IC or more, seen with the entity in `support` different texts or more, is marked wherever the entity's documents hold it, so values of one text are disclosed by what they share with others. Everything here is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import fits, materialise, table

#: Kinds in their order. Quantifiers are possessive and starts are bound to where a run begins (or the last match ended), which finds the same matches in linear time and without recursion.
PATTERNS: dict[str, str] = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried at all.
HINTS: dict[str, str] = {"email": "@", "phone": "+"}
TERM = r"[\p{L}\p{N}]*+"
BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def running(lengths: Column) -> Column:
    """Running sums of a non-empty array of ints, by blocks: time grows little faster than the array."""

    def fold(a: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("a"))
        step = lambda s, x: F.struct((s["n"] + x).alias("n"), F.array_append(s["a"], s["n"] + x).alias("a"))
        return F.aggregate(a, start, step, lambda s: s["a"])

    def blocks(a: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(a), F.lit(BLOCK))
        return F.transform(starts, lambda i: fold(F.slice(a, i, F.lit(BLOCK))))

    def joined(b: Column) -> Column:
        ends = fold(F.transform(b, lambda x: F.element_at(x, -1)))
        return let(ends, lambda e: F.flatten(F.transform(b, lambda x, i: F.transform(x, lambda v: v + F.when(i > 0, F.get(e, i - 1)).otherwise(0)))))

    return let(lengths, lambda a: let(blocks(a), joined))


def located(text: Column, pattern: Column) -> Column:
    """array<struct<start, end, value>> of all matches: offsets in code points."""

    def spans(found: Column) -> Column:
        def placed(between: Column) -> Column:
            steps = F.zip_with(F.slice(between, F.lit(1), F.size(found)), F.concat(F.array(F.lit("")), F.slice(found, 1, F.size(found) - 1)), lambda g, m: F.length(g) + F.length(m))
            starts = running(steps)
            return F.zip_with(found, starts, lambda m, s: F.struct(s.alias("start"), (s + F.length(m)).alias("end"), m.alias("value")))

        return F.when(F.size(found) > 0, let(F.split(text, pattern, -1), placed))

    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.coalesce(let(F.regexp_extract_all(text, pattern, F.lit(0)), spans), none)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(s: Column, x: Column) -> Column:
        d = F.when(s["odd"], F.when(x > 4, 2 * x - 9).otherwise(2 * x)).otherwise(x)
        return F.struct((s["sum"] + d).alias("sum"), (~s["odd"]).alias("odd"))

    each = F.transform(F.split(F.reverse(digits), ""), lambda x: F.when(x != "", x.cast("int")))
    return F.aggregate(F.filter(each, lambda x: x.isNotNull()), F.struct(F.lit(0).alias("sum"), F.lit(False).alias("odd")), add, lambda s: s["sum"] % 10 == 0)


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: let(F.regexp_replace(p, "^0+(?=[0-9])", ""), lambda d: (F.length(d) < 3) | ((F.length(d) == 3) & (d <= "255"))))
    if kind == "card":
        return let(_digits(value), lambda d: F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def values(docs: DataFrame) -> DataFrame:
    """(doc_id, key, email, ip, card, phone) for every row: the valid matches of each kind; key is a hash of the whole text."""
    text = F.coalesce("text", F.lit(""))
    out = docs.select("doc_id", text.alias("_text"))
    found = []
    for kind, pattern in PATTERNS.items():
        got = F.filter(located(F.col("_text"), F.lit(pattern)), _check(kind))
        hint = F.col("_text").contains(HINTS[kind]) if kind in HINTS else F.col("_text").rlike(r"[0-9]\.[0-9]" if kind == "ip" else r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]")
        found.append(F.when(hint, got).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>")).alias(kind))
    return out.select("doc_id", F.sha2("_text", 256).alias("key"), *found)


def _check(kind: str) -> Callable[[Column], Column]:
    return lambda m: _valid(kind, m["value"])


def _entities(kind: str) -> Callable[[Column], Column]:
    """A value, without what doesn't tell values apart, and the part it shares with others, both by kind."""

    def named(m: Column) -> Column:
        value = F.lower(m["value"]) if kind == "email" else m["value"] if kind == "ip" else _digits(m["value"])
        part = {"email": lambda: F.substring_index(value, "@", -1), "ip": lambda: F.substring_index(value, ".", 3), "card": lambda: F.left(value, F.lit(6)), "phone": lambda: F.left(value, F.length(value) - 4)}[kind]()
        return F.array(F.concat(F.lit(f"{kind}:"), value), F.concat(F.lit(f"{kind} part:"), part))

    return named


def _held() -> Column:
    """All entities of a row of values()."""
    return F.array_distinct(F.flatten(F.flatten(F.array(*(F.transform(k, _entities(k)) for k in PATTERNS)))))


def _labelled(kind: str) -> Callable[[Column], Column]:
    return lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("less"), s["end"].alias("end"), F.lit(kind).alias("kind"))


def _said(kind: str) -> Callable[[Column], Column]:
    return lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string"))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]++"), F.lit(0))


def _texts(docs: DataFrame, keys: DataFrame, broadcast_rows: int) -> DataFrame:
    """(key, _text): each text once whose key is among keys, a table that materialise() wrote. Keys go to the texts where they fit, so that only texts that are asked for are shuffled."""
    texts = docs.select(F.coalesce("text", F.lit("")).alias("_text")).withColumn("key", F.sha2("_text", 256))
    return texts.join(F.broadcast(keys) if fits(keys, broadcast_rows) else keys, "key", "left_semi").dropDuplicates(["key"])


def disclosing(docs: DataFrame, found: DataFrame, support: int = 2, share: float = 0.6, broadcast_rows: int = 500_000) -> DataFrame:
    """(entity, term): terms that disclose an entity. Counts are of rows, repeated ones and those without an id included, over the whole corpus and whole texts; terms have three letters or more and are no numbers. Entities of fewer than `support` different texts can have no such term and go before their texts are read. Of the words of all documents only those met with entities are counted."""
    holders = found.where(" or ".join(f"size({k}) > 0" for k in PATTERNS)).groupBy("key").agg(F.count("*").alias("copies"), F.first(_held()).alias("held")).select("key", "copies", F.explode("held").alias("entity"))
    holders = materialise(holders, "holders")
    entities = materialise(holders.groupBy("entity").agg(F.sum("copies").alias("n_entity"), F.count("*").alias("texts")).where(F.col("texts") >= support).drop("texts"), "entities")
    small = fits(entities, broadcast_rows)
    holders = materialise(holders.join(F.broadcast(entities) if small else entities, "entity", "left_semi"), "holders")
    keys = materialise(holders.select("key").distinct(), "keys")
    terms = _texts(docs, keys, broadcast_rows).select("key", F.explode(F.array_distinct(_words(F.col("_text")))).alias("term")).where("length(term) >= 3 and not term rlike '^[0-9]+$'")
    both = materialise(holders.join(terms, "key").groupBy("entity", "term").agg(F.sum("copies").alias("n_both"), F.count("*").alias("texts")).where(F.col("texts") >= support), "pairs")
    if both.isEmpty():
        return both.select("entity", "term")
    wanted = materialise(both.select("term").distinct(), "terms")
    spoken = docs.select(F.explode(F.array_distinct(_words(F.coalesce("text", F.lit(""))))).alias("term"))
    if fits(wanted, broadcast_rows):
        known = spoken.join(F.broadcast(wanted), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_term"))
    else:
        known = spoken.groupBy("term").agg(F.count("*").alias("n_term")).join(wanted, "term", "left_semi")
    n = docs.count()
    pmi = F.log2(F.lit(float(n)) * F.col("n_both") / (F.col("n_entity") * F.col("n_term")))
    return both.join(F.broadcast(entities) if small else entities, "entity").join(known, "term").where((pmi > 0) & (pmi >= share * F.log2(F.lit(float(n)) / F.col("n_entity")))).select("entity", "term")


def _told(found: DataFrame, told: DataFrame, broadcast_rows: int) -> tuple[DataFrame, DataFrame]:
    """(key, set) and (set, terms), written tables: texts of equal sets of entities share their list of terms, which is many times as large as the entities are."""
    told = materialise(told, "told")
    entities = materialise(told.select("entity").distinct(), "entities")
    holders = found.select("key", F.explode(_held()).alias("entity")).distinct()
    holders = holders.join(F.broadcast(entities) if fits(entities, broadcast_rows) else entities, "entity", "left_semi")
    held = holders.groupBy("key").agg(F.sort_array(F.collect_list("entity")).alias("held"))
    held = materialise(held.select("key", F.sha2(F.array_join("held", "\n"), 256).alias("set"), "held"), "held")
    members = held.groupBy("set").agg(F.first("held").alias("held")).select("set", F.explode("held").alias("entity"))
    by_set = members.join(told, "entity").groupBy("set").agg(F.sort_array(F.collect_set("term")).alias("terms"))
    return materialise(held.select("key", "set"), "keys"), materialise(by_set, "terms")


def personal_data(docs: DataFrame, support: int = 2, share: float = 0.6, broadcast_rows: int = 500_000) -> DataFrame:
    """(doc_id, key, email, ip, card, phone, term) for every row: key is a hash of the text; arrays of (start, end) in code points, end exclusive, of each kind; term holds the disclosing terms outside the others.

    Null and empty texts hold nothing. Repeated rows and null ids are kept and count as rows; an empty table gives an empty result; other columns, whatever their names, are ignored. Texts are read whole.
    """
    found = materialise(values(docs), "values")
    told = disclosing(docs, found, support, share, broadcast_rows)
    keys, by_set = _told(found, told, broadcast_rows)
    texts = _texts(docs, keys, broadcast_rows).join(F.broadcast(keys) if fits(keys, broadcast_rows) else keys, "key")
    texts = texts.join(F.broadcast(by_set) if fits(by_set, broadcast_rows) else by_set, "set")
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join("terms", "|"), F.lit(r")(?![\p{L}\p{N}])"))
    spoken = texts.select("key", "_text", pattern.alias("_pattern")).select("key", F.transform(located(F.col("_text"), F.col("_pattern")), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))).alias("term"))
    spoken = materialise(spoken, "spoken")
    short = lambda k: F.transform(k, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))).alias(k)
    joined = found.join(F.broadcast(spoken) if fits(spoken, broadcast_rows) else spoken, "key", "left").select("doc_id", "key", *(short(k) for k in PATTERNS), F.coalesce("term", F.array().cast("array<struct<start:int,end:int>>")).alias("term"))
    taken = F.flatten(F.array(*PATTERNS))
    free = F.filter("term", lambda t: ~F.exists(taken, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return joined.withColumn("term", free)


def sanitised(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, text) with every span of personal_data put into words of its kind, such as [EMAIL]; disclosing terms become [TERM]. Where spans of two kinds overlap the earlier, then longer, stands."""
    found = personal_data(docs, **options).dropDuplicates(["key"])
    kinds = [*PATTERNS, "term"]
    every = F.array_sort(F.flatten(F.array(*(F.transform(k, _labelled(k)) for k in kinds))))
    spans = found.select("key", every.alias("_spans"))
    joined = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")).withColumn("key", F.sha2("_text", 256)).join(spans, "key")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda s, x: F.when(x["start"] >= s["at"], F.struct(x["end"].alias("at"), F.concat(s["out"], F.substring(F.col("_text"), s["at"] + 1, x["start"] - s["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]")).alias("out"))).otherwise(s)
    text = F.aggregate("_spans", start, step, lambda s: F.concat(s["out"], F.substring(F.col("_text"), s["at"] + 1, F.length("_text"))))
    return joined.select("doc_id", text.alias("text"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    said = {k: F.transform(k, _said(k)) for k in [*PATTERNS, "term"]}
    base = F.array_join(F.concat(*(said[k] for k in PATTERNS)), ",")
    return found.select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS), F.sha2(base, 256).alias("base_sha256"),
        F.array_join(F.concat(*said.values()), ",").alias("spans"), F.size("term").cast("long").alias("n_term"),
    )
