"""Line deduplication by an exact set-similarity join.

A line is the set of its words in lower case. Lines with a Jaccard similarity of 0.8 or more to an earlier line go; earlier means of smaller doc_id, then smaller line number. Lines of equal sets are reduced to their first place beforehand. Words are ordered by rarity (the counts of lines that hold them, hashed into a fixed number of counters); of two like lines the longer is looked up under its rarest words, as many as the prefix filter asks for, and the shorter is listed under the few rarest that lines no shorter than itself can still meet. Words are listed by classes of length, so only lines of like lengths meet; pairs that meet pass the length and positional filters and a bound on their difference by parity signatures, and are verified on their words. Most members of a large group of like lines go in a first round, each compared only with the first line of its part of the list, so that groups never become all their pairs. Everything here is DataFrame functions.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.llm.common import discard, fits, materialise, table

COUNTERS = 1 << 17
#: Lines of about so many words or more have signatures of 128 bits, shorter ones of 64.
WIDE = 64
#: Parts of a list in the first round: a group of like lines is dealt to so many tasks.
PARTS = 32
#: Lists are met in so many rounds, which divides the disk that they take.
ROUNDS = 2
#: A line is compared with one partner first, then with so many times as many as it was compared with before.
STEP = 16


def _split(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _plain(text: Column) -> Column:
    """text in lower case, with every kind of white space but the line feed as blanks."""
    other = reduce(Column.__or__, (F.contains(text, F.lit(c)) for c in "\t\r\f\x0b"))  # looks at bytes, which a pattern doesn't
    return F.lower(F.when(other, F.translate(text, "\t\r\f\x0b", "    ")).otherwise(text))


def _hash(word: Column) -> Column:
    """56 bits for a word."""
    return F.shiftrightunsigned(F.xxhash64(word), 8)


def _words(line: Column, hashed: Callable[[Column], Column] = F.xxhash64) -> Column:
    """Hashes of the distinct words of a plain line."""
    return F.array_remove(F.array_distinct(F.transform(F.split(line, " ", -1), lambda w: hashed(w))), hashed(F.lit("")))


def _levels(words: DataFrame) -> DataFrame:
    """One row: the array of the counters' levels, the logarithms of the counts of the words in each, in a long's high bits. It has COUNTERS members, whatever the corpus."""
    counted = words.select(F.explode("words").alias("h")).groupBy(F.col("h").bitwiseAND(F.lit(COUNTERS - 1)).alias("b")).count()
    every = words.sparkSession.range(COUNTERS).join(F.broadcast(counted), F.col("id") == F.col("b"), "left")
    level = F.shiftleft(F.coalesce(F.least(F.floor(3 * F.log2(F.coalesce("count", F.lit(0)) + 1)), F.lit(126)), F.lit(0)).cast("long"), 56)  # never null, so that keys are sorted as plain longs
    return every.agg(F.sort_array(F.collect_list(F.struct("id", level.alias("level")))).alias("a")).select(F.col("a.level").alias("levels"))


def _keys(words: Column, levels: Column) -> Column:
    """Sorted array of a line's words as longs, the rarest first: level in the high bits, hash in the low 56."""
    return F.sort_array(F.transform(words, lambda h: levels[h.bitwiseAND(F.lit(COUNTERS - 1))].bitwiseOR(h)))


def _parity(keys: Column, bits: list[int]) -> Column:
    """64 bits, the exclusive or of the members of bits that the low bits of each key name."""
    named = F.array(*(F.lit(b).cast("long") for b in bits))  # looked up, as shifts cost twice as many steps for each word
    return F.aggregate(keys, F.lit(0).cast("long"), lambda s, k: s.bitwiseXOR(named[k.bitwiseAND(F.lit(len(bits) - 1))]))


def _overlap(n: Column, m: Column, percent: int) -> Column:
    """Words that sets of n and m must share."""
    return F.ceil((n + m) * percent / F.lit(100 + percent) - 1e-9)


def _first(n: Column, percent: int) -> Column:
    """How many of n words a line is looked up under."""
    return (n - F.ceil(n * percent / F.lit(100) - 1e-9) + 1).cast("int")


def _listed(n: Column, percent: int) -> Column:
    """How many of n words a line is listed under: those that lines of n words or more can meet it by."""
    return (n - _overlap(n, n, percent) + 1).cast("int")


def _class(n: Column, percent: int) -> Column:
    """The class of a length: each is wider than the one before by the ratio that like lines' lengths may have."""
    return F.floor(F.log(n) / math.log(100 / percent) + 1e-9)


def _key(*parts: Column) -> Column:
    """44 bits for a place in a list."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 20)


def _signed(rows: DataFrame, percent: int) -> DataFrame:
    """rows with the signature that lines of class c compare: both halves where lines are wide, else their sum."""
    wide = F.col("c") >= _class(F.lit(WIDE), percent)
    return rows.withColumns({"a": F.when(wide, F.col("odd")).otherwise(F.col("odd").bitwiseXOR(F.col("even"))), "b": F.when(wide, F.col("even")).otherwise(F.lit(0))})


def _close(x: str, y: str, percent: int) -> Column:
    """Whether lines x and y that meet under a word pass the length, positional and parity filters."""
    at, n = (lambda s: F.col(f"{s}m").bitwiseAND(F.lit((1 << 32) - 1))), (lambda s: F.shiftright(f"{s}m", 32))
    spare = n(x) + n(y) - 2 * _overlap(n(x), n(y), percent)
    need = _overlap(n(x), n(y), percent)
    length = (n(x) * 100 >= n(y) * percent) & (n(y) * 100 >= n(x) * percent)
    place = (n(x) - at(x) >= need) & (n(y) - at(y) >= need) & (at(x) + at(y) <= spare)
    parity = F.bit_count(F.col(f"{x}a").bitwiseXOR(F.col(f"{y}a"))) + F.bit_count(F.col(f"{x}b").bitwiseXOR(F.col(f"{y}b"))) <= spare
    return length & place & parity


def _posted(distinct: DataFrame, many: Column, part: int | None = None) -> DataFrame:
    """A row for each of the first `many` words of each line, or those of one part of ROUNDS; m holds the line's length and the word's position."""
    also = [c for c in ("gone",) if c in distinct.columns]
    rows = distinct.select("doc_id", "ln", "n", "odd", "even", *also, F.posexplode(F.slice("prefix", F.lit(1), many)).alias("at", "token"))
    rows = rows if part is None else rows.where(F.col("token") % ROUNDS == part)
    return rows.withColumn("m", F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("at").cast("long")))


def _to_leads(distinct: DataFrame, percent: int) -> DataFrame:
    """(y, x): lines and the first line in their part of a list, where the filters allow it."""
    rows = _signed(_posted(distinct, _listed(F.col("n"), percent)).withColumn("c", _class(F.col("n"), percent)), percent)
    part = F.pmod(F.xxhash64("doc_id", "ln"), F.lit(PARTS))
    rows = rows.select(_key(F.col("token"), F.col("c"), part).alias("key"), "doc_id", "ln", "m", "a", "b")
    lead = F.first(F.struct("doc_id", "ln", "m", "a", "b")).over(W.partitionBy("key").orderBy("doc_id", "ln").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("x", lead).where((F.col("x.doc_id") != F.col("doc_id")) | (F.col("x.ln") != F.col("ln")))
    return rows.where(_close("x.", "", percent)).select(F.col("doc_id").alias("y_doc_id"), F.col("ln").alias("y_ln"), F.col("x.doc_id").alias("x_doc_id"), F.col("x.ln").alias("x_ln")).distinct()


def _meetings(longer: DataFrame, shorter: DataFrame, percent: int, part: int | None, few: bool = False) -> DataFrame:
    """(y, x), y the later and not gone: lines of longer and lines of shorter, no longer than they, where the filters allow it. Words looked up that are few, as counted, are sent to the lists, and not the lists to them."""
    given = ("doc_id", "ln", "m", "a", "b", "gone")
    asked = _signed(_posted(longer, _first(F.col("n"), percent), part).withColumn("c", _class(F.col("n"), percent)), percent)
    asked = asked.select(_key(F.col("token"), F.col("c")).alias("p_key"), *(F.col(c).alias(f"p_{c}") for c in given))
    rows = _posted(shorter, _listed(F.col("n"), percent), part)
    most = (F.col("n") - F.col("at")) * ((100 + percent) / percent) - F.col("n")  # the longest line that can meet this one here
    rows = _signed(rows.withColumn("c", F.explode(F.sequence(_class(F.col("n"), percent), _class(F.greatest(F.col("n").cast("double"), most), percent)))), percent)
    rows = rows.select(_key(F.col("token"), F.col("c")).alias("q_key"), *(F.col(c).alias(f"q_{c}") for c in given))
    n, k = F.shiftright("p_m", 32), F.shiftright("q_m", 32)
    after = (F.col("p_doc_id") > F.col("q_doc_id")) | ((F.col("p_doc_id") == F.col("q_doc_id")) & (F.col("p_ln") > F.col("q_ln")))
    wanted = ((n > k) | ((n == k) & after)) & ~F.when(after, F.col("p_gone")).otherwise(F.col("q_gone"))
    met = (F.broadcast(asked) if few else asked).join(rows, (F.col("p_key") == F.col("q_key")) & wanted & _close("p_", "q_", percent))
    end = lambda first, second, name: [F.when(after, F.col(f"{first}_{c}")).otherwise(F.col(f"{second}_{c}")).alias(f"{name}_{c}") for c in ("doc_id", "ln")]
    return met.select(*end("p", "q", "y"), *end("q", "p", "x")).distinct()


def _without(rows: DataFrame, gone: DataFrame, small: bool, kind: str = "left_anti") -> DataFrame:
    return rows.join(F.broadcast(gone) if small else gone, ["doc_id", "ln"], kind)


def _verified(pairs: DataFrame, docs: DataFrame, percent: int, broadcast_rows: int) -> DataFrame:
    """(doc_id, ln) of the later lines in pairs whose words, as hashes of 64 bits, are close enough to an earlier one's; a written table. One such pair tells enough of a line: lines are compared with their first partner, those left with the next STEP, and so on by powers of STEP to the last, so that a large group of like lines never becomes all its pairs."""
    order = W.partitionBy("y_doc_id", "y_ln").orderBy("x_doc_id", "x_ln")
    pairs = materialise(pairs.withColumn("place", F.row_number().over(order)), "pairs")
    ends = [pairs.select(*(F.col(f"{s}_{c}").alias(f"_{c}") for c in ("doc_id", "ln"))) for s in "yx"]
    wanted = materialise(ends[0].unionByName(ends[1]).distinct().groupBy("_doc_id").agg(F.collect_list("_ln").alias("_lns")), "wanted")
    small = fits(wanted, broadcast_rows)
    held = docs.join(F.broadcast(wanted) if small else wanted, docs["doc_id"] == wanted["_doc_id"])
    picked = F.transform(F.array(_split(_plain(F.col("text")))), lambda lines: F.transform("_lns", lambda i: F.struct(i.alias("ln"), F.get(lines, i).alias("line"))))[0]  # the text is split once, not once for each line
    text = held.select("doc_id", F.explode(picked).alias("l"))
    sets = materialise(text.select("doc_id", F.col("l.ln").alias("ln"), _words(F.col("l.line")).alias("words")).dropDuplicates(["doc_id", "ln"]), "sets")
    last = pairs.agg(F.max("place")).first()[0] or 0
    done, rounds, most = 0, [], 1
    while done < last or not rounds:
        asked = pairs.where(F.col("place").between(done + 1, most))
        for had in rounds:
            asked = asked.join(F.broadcast(had) if fits(had, broadcast_rows) else had, (F.col("y_doc_id") == had["doc_id"]) & (F.col("y_ln") == had["ln"]), "left_anti")
        rounds.append(materialise(_alike(asked, sets, percent), "found"))
        done, most = most, most * (STEP + 1)
    discard(pairs, wanted, sets)
    if len(rounds) == 1:
        return rounds[0]
    found = materialise(reduce(DataFrame.unionByName, rounds), "found")
    discard(*rounds)
    return found


def _alike(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(doc_id, ln) of the y in pairs whose words are close enough to some x's."""
    y, x = (sets.select(F.col("doc_id").alias(f"{s}_doc_id"), F.col("ln").alias(f"{s}_ln"), F.col("words").alias(f"{s}_words")) for s in "yx")
    both = pairs.join(y, ["y_doc_id", "y_ln"]).join(x, ["x_doc_id", "x_ln"])
    shared = F.size(F.array_intersect("x_words", "y_words"))
    close = shared * 100 >= (F.size("x_words") + F.size("y_words") - shared) * percent
    return both.where(close).select(F.col("y_doc_id").alias("doc_id"), F.col("y_ln").alias("ln")).distinct()


def kept_lines(docs: DataFrame, percent: int = 80, broadcast_rows: int = 200_000) -> DataFrame:
    """(doc_id, kept): numbers, from 0, of the lines with words that stay; a written table."""
    docs = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    lines = docs.select("doc_id", F.posexplode(_split(_plain(F.col("text")))).alias("ln", "line"))
    words = materialise(lines.select("doc_id", "ln", _words(F.col("line"), _hash).alias("words")), "words")  # texts are split once, for counting and for keys
    keyed = words.select("doc_id", "ln", "words", _levels(words).scalar().alias("levels")).select("doc_id", "ln", _keys(F.col("words"), F.col("levels")).alias("keys"))
    n = F.size("keys")
    short = _class(F.greatest(n, F.lit(1)), percent) + 1 < _class(F.lit(WIDE), percent)  # such lines meet none in wide classes
    bits, none = [1 << i for i in range(63)] + [-1 << 63], [0] * 64
    rest = F.struct(
        n.alias("n"), F.when(short, _parity(F.col("keys"), bits)).otherwise(_parity(F.col("keys"), none + bits)).alias("odd"),
        F.when(short, F.lit(0).cast("long")).otherwise(_parity(F.col("keys"), bits + none)).alias("even"),
        F.slice("keys", F.lit(1), F.when(n < 4, 0).otherwise(_first(n, percent))).alias("prefix"),
    )
    firsts = keyed.select(F.xxhash64("keys").alias("hash"), "doc_id", "ln", rest.alias("rest")).select("hash", "rest.n", "rest.odd", "rest.even", "doc_id", "ln", "rest")
    firsts = firsts.groupBy("hash", "n", "odd", "even").agg(F.min(F.struct("doc_id", "ln")).alias("p"), F.first("rest.prefix").alias("prefix"))
    distinct = materialise(firsts.select("p.doc_id", "p.ln", "n", "odd", "even", "prefix"), "lines")
    discard(words)
    gone = _verified(_to_leads(distinct, percent), docs, percent, broadcast_rows)
    small = fits(gone, broadcast_rows)
    out = materialise(_without(distinct, gone, small, "left_semi").withColumn("gone", F.lit(True)), "out")
    few = (out.agg(F.sum(F.size("prefix"))).first()[0] or 0) <= broadcast_rows
    left = _without(distinct, gone, small).withColumn("gone", F.lit(False))
    every = left.unionByName(out)
    met = [materialise(_meetings(left, every, percent, part).unionByName(_meetings(out, left, percent, part)) if not few else _meetings(left, every, percent, part), "met") for part in range(ROUNDS)]
    met += [materialise(_meetings(out, left, percent, None, few), "met")] if few else []
    found = _verified(reduce(DataFrame.unionByName, met).distinct(), docs, percent, broadcast_rows)
    every = materialise(gone.unionByName(found).distinct(), "gone")
    kept = materialise(_without(distinct, every, fits(every, broadcast_rows)).groupBy("doc_id").agg(F.collect_list("ln").alias("kept")), "kept")
    discard(distinct, gone, out, found, every, *met)
    return kept


def deduplicate(docs: DataFrame, percent: int = 80, counts: bool = True, length: str | None = None, broadcast_rows: int = 200_000) -> DataFrame:
    """docs with text freed of lines that are like an earlier one and, with counts, the columns n_lines and n_removed; columns of docs of these names give way to them. A column named by `length` follows the text's length where lines go.

    Lines without words stay; every other line takes part, however short. A document whose lines all go keeps an empty text. Null texts stay null. Rows with a null doc_id stay as they are and are compared with nothing. Rows that repeat an id are one document: a line goes from them unless one of them holds, under the same number, a line that stays. Empty table: empty result. All other columns are kept as they are, whatever their names.
    """
    kept = kept_lines(docs, percent, broadcast_rows).select(F.col("doc_id").alias("_id"), "kept")
    rows = docs.select(F.col("doc_id").alias("_d"), F.col("text").alias("_text"), F.struct(*(docs[c] for c in docs.columns)).alias("_row"))
    joined = rows.join(kept.hint("shuffle_hash"), F.col("_d") == F.col("_id"), "left")
    lines = _split(F.col("_text"))
    numbers = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(r"\S"), i).otherwise(F.lit(-1))), lambda i: i >= 0)
    removed = F.when(F.col("_d").isNotNull(), F.array_except(numbers, F.coalesce("kept", F.array().cast("array<int>"))))
    joined = joined.select("_row", "_text", removed.alias("_removed"))
    many = F.coalesce(F.size("_removed"), F.lit(0))
    text = F.when(many > 0, _rejoined(F.col("_text"), F.col("_removed"))).otherwise(F.col("_text"))
    out = joined.select("_row", text.alias("_text"), many.alias("_many"), F.size(lines).alias("_lines"))

    def column(f) -> Column:
        if f.name == "text":
            return F.col("_text").alias(f.name)
        own = F.col("_row")[f.name]
        return (F.when(F.col("_many") > 0, F.length("_text").cast(f.dataType)).otherwise(own) if f.name == length else own).alias(f.name)

    added = {"n_lines": F.when(F.col("_text").isNotNull(), F.col("_lines")).otherwise(0), "n_removed": F.when(F.col("_text").isNotNull(), F.col("_many")).otherwise(0)} if counts else {}
    return out.select(*(column(f) for f in docs.schema.fields if f.name not in added), *(c.alias(k) for k, c in added.items()))


def _rejoined(text: Column, removed: Column) -> Column:
    def without(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), removed)
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")

    return F.transform(F.array(_split(text)), without)[0]


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: DuckDB SQL for op6_lines, over the same pairs that a prefix filter leaves.
ORACLE_SQL = r"""
WITH a AS (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents),
o AS (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM a),
l AS (SELECT doc_id, i, s[i] AS line, regexp_matches(s[i], '\S') AS counts FROM o),
u AS (SELECT line, min({'d': doc_id, 'i': i}) AS p, any_value(list_distinct(list_filter(string_split(translate(lower(line), E'\t\r\f\x0b', '    '), ' '), lambda x: x != ''))) AS w FROM l WHERE counts GROUP BY line),
t AS (SELECT p, len(w) AS n, unnest(w) AS word FROM u),
r AS (SELECT p, n, word, row_number() OVER (PARTITION BY p ORDER BY df, word) AS k FROM (SELECT *, count(*) OVER (PARTITION BY word) AS df FROM t)),
f AS (SELECT * FROM r WHERE k <= n - ceil(0.8 * n - 0.000000001) + 1),
c AS (SELECT DISTINCT x.p AS xp, y.p AS yp FROM f x JOIN f y USING (word) WHERE x.p < y.p AND x.n * 100 >= y.n * 80 AND y.n * 100 >= x.n * 80),
g AS (SELECT DISTINCT yp FROM (SELECT yp, x.w AS xw, y.w AS yw, len(list_intersect(x.w, y.w)) AS shared FROM c JOIN u x ON x.p = xp JOIN u y ON y.p = yp) WHERE shared * 100 >= (len(xw) + len(yw) - shared) * 80),
k AS (SELECT l.doc_id, l.i, l.line, NOT counts OR (u.p = {'d': l.doc_id, 'i': l.i} AND u.p NOT IN (SELECT yp FROM g)) AS kept FROM l LEFT JOIN u ON l.line = u.line AND l.counts)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (kept), '') AS text, count(*)::INT AS n_lines, (count(*) FILTER (NOT kept))::INT AS n_removed FROM k GROUP BY doc_id
"""
