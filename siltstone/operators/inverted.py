"""A stored inverted index: written once, kept between applications, then every search reads the postings of its own terms only.

Three Parquet tables lie in the index's folder: postings (field, term, key, tf, words, at) in order of field, term and key, so that a search prunes by the files' ranges and pages; terms (field, term, df, total); fields (field, n, total), written last. at holds the places of the term among the field's words, so phrases need no texts. Further documents are appended as rows of their own in all three.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.text import tokens
from siltstone.operators.search import B, K1
from siltstone.sources.tables import written

_PART = re.compile(r'\s*(?:(?P<open>\()|(?P<close>\))|(?P<field>\w+):|(?P<start>\^)|"(?P<phrase>[^"]*)"|(?P<word>[^\s()":^*]+)(?P<prefix>\*)?)')


def write(docs: DataFrame, path: str, key: str = "doc_id", fields: Sequence[str] = ("text",)) -> None:
    """Indexes the named text columns of docs under path, in place of what is there. Keys are unique and not null; null and empty texts count as rows without words. A frequent term is cut by its keys, so no task holds all of its postings."""
    _add(docs, path, key, fields, "overwrite")


def append(docs: DataFrame, path: str, key: str = "doc_id") -> None:
    """Adds further documents to an index. A key that it has already stops the job before anything is written; a reader that was open keeps seeing what was there."""
    spark = docs.sparkSession
    fields = [r["field"] for r in spark.read.parquet(f"{path}/fields").select("field").distinct().orderBy("field").collect()]
    held = spark.read.parquet(f"{path}/postings").select(F.col(key).alias("_key"))
    again = docs.select(key).join(held, F.col(key) == F.col("_key"), "left_semi").limit(1).collect()
    if again:
        raise ValueError(f"key {again[0][0]!r} is in the index")
    _add(docs, path, key, fields, "append")


def _add(docs: DataFrame, path: str, key: str, fields: Sequence[str], mode: str) -> None:
    spark = docs.sparkSession
    found = written(_gathered(docs, key, fields), "postings")
    parts = found.repartitionByRange("field", "term", F.get("keys", F.lit(0)))
    single = parts.select("field", "term", F.explode(F.arrays_zip("keys", "words", "at")).alias("_p"))
    single = single.select("field", "term", F.col("_p.keys").alias(key), F.size("_p.at").alias("tf"), "_p.words", "_p.at")
    single.sortWithinPartitions("field", "term", key).write.mode(mode).parquet(f"{path}/postings")
    terms = written(found.groupBy("field", "term").agg(F.sum(F.size("keys").cast("long")).alias("df"), F.sum("total").alias("total")), "terms")
    terms.repartitionByRange("field", "term").sortWithinPartitions("field", "term").write.mode(mode).parquet(f"{path}/terms")
    totals = {r["field"]: r["total"] for r in terms.groupBy("field").agg(F.sum("total").alias("total")).collect()}
    n = docs.count()
    rows = [(f, n, totals.get(f, 0)) for f in fields]
    spark.createDataFrame(rows, "field string, n long, total long").coalesce(1).write.mode(mode).parquet(f"{path}/fields")


def _gathered(docs: DataFrame, key: str, fields: Sequence[str], size: int = 2000) -> DataFrame:
    """(field, term, total, keys, words, at): for each term of `size` rows of docs at most, how often they have it, the keys that hold it, those fields' lengths, and its places in each. A posting crosses to another task only in such a list, so its term is told once for all of them."""
    kind = docs.schema[key].dataType
    wide = F.array(*(tokens(F.col(f)) for f in fields))

    def lists(ends: np.ndarray, values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(at, size) for x in batches for at in range(0, x.num_rows, size)):
            keys, held = b.column(0), b.column(1)
            for n, field in enumerate(fields):
                own = pa.compute.list_element(held, n)
                words = pa.compute.fill_null(pa.compute.list_value_length(own), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                coded = own.flatten().dictionary_encode()
                if not len(coded):
                    continue
                row = np.repeat(np.arange(len(words)), words)
                place = np.arange(len(row)) - np.repeat(np.cumsum(words) - words, words)
                code = coded.indices.to_numpy(zero_copy_only=False)
                order = np.argsort(code, kind="stable")  # rows and places keep their order within a term
                code, row, place = code[order], row[order], place[order]
                first = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (row[1:] != row[:-1])]))
                new = np.flatnonzero(np.concatenate([[True], np.diff(code[first]) != 0]))  # where a term's postings begin
                ends, total = np.append(new, len(first)), np.diff(np.append(first[new], len(code)))
                term = coded.dictionary.take(pa.array(code[first[new]]))
                at = lists(np.append(first, len(code)), pa.array(place.astype(np.int32)))
                columns = [pa.array([field] * len(term), pa.string()), term.cast(pa.string()), pa.array(total.astype(np.int64)), lists(ends, keys.take(pa.array(row[first]))), lists(ends, pa.array(words[row[first]].astype(np.int32))), lists(ends, at)]
                yield pa.RecordBatch.from_arrays(columns, ["field", "term", "total", "keys", "words", "at"])

    schema = f"field string, term string, total long, keys array<{kind.simpleString()}>, words array<int>, at array<array<int>>"
    return docs.select(key, wide.alias("_w")).mapInArrow(run, schema)


class Index:
    """An index that write() left under path."""

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id"):
        self.key = key
        self.postings, self.terms = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/terms")
        told = spark.read.parquet(f"{path}/fields").groupBy("field").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.count("*").alias("times")).collect()
        self.fields = {r["field"]: (r["n"], r["total"]) for r in told}
        if any(r["times"] > 1 for r in told):  # appended to: a term has a row of each time
            self.terms = self.terms.groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))

    def frequencies(self, terms: Sequence[str], field: str = "text") -> dict[str, int]:
        """Documents that hold each of the query's terms."""
        held = self.terms.where((F.col("field") == field) & F.col("term").isin(*terms))
        return {r["term"]: r["df"] for r in held.select("term", "df").collect()}

    def weighed(self, terms: Sequence[str], weights: Mapping[str, float]) -> DataFrame:
        """(key, score, held): the weighted sum of each field's BM25, and how many postings of the terms the fields have."""
        terms = list(dict.fromkeys(terms))
        parts = []
        for field, weight in weights.items():
            n, total = self.fields[field]
            df = self.frequencies(terms, field)
            average = max(1.0, total / max(1, n))
            if not df:
                continue
            idf = reduce(lambda c, t: c.when(F.col("term") == t, weight * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))), df, F)
            parts.append(
                self.postings.where((F.col("field") == field) & F.col("term").isin(*df))
                .select(self.key, "term", (idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("words") / average))).alias("score"))
            )
        if not parts:
            return self.postings.limit(0).select(self.key, F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("held"))
        rows = reduce(DataFrame.unionByName, parts)
        return rows.groupBy(self.key).agg(F.sum("score").alias("score"), F.count("*").alias("held"))

    def bm25(self, terms: Sequence[str], field: str = "text") -> DataFrame:
        """(key, score) of documents that hold a term in the field."""
        return self.weighed(terms, {field: 1.0}).select(self.key, "score")

    def bm25_near(self, terms: Sequence[str], field: str = "text", bonus: float = 0.5, most: int = 3) -> DataFrame:
        """(key, score): BM25, and `bonus` for each time that two neighbouring words of the query are neighbours in the field, `most` times at most; from the postings alone."""
        pairs = sorted(set(zip(terms, terms[1:], strict=False)))
        scored = self.bm25(terms, field)
        if not pairs:
            return scored
        words = sorted({w for pair in pairs for w in pair})
        places = [F.flatten(F.collect_list(F.when(F.col("term") == w, F.col("at")))).alias(f"_p{i}") for i, w in enumerate(words)]
        held = self.postings.where((F.col("field") == field) & F.col("term").isin(*words)).groupBy(F.col(self.key).alias("_key")).agg(*places)
        met = reduce(Column.__add__, (F.size(F.array_intersect(_shifted(F.col(f"_p{words.index(a)}"), -1), F.col(f"_p{words.index(b)}"))) for a, b in pairs))
        near = held.select("_key", F.least(F.lit(most), met).alias("_met"))
        return scored.join(near, F.col(self.key) == F.col("_key"), "left").select(self.key, (F.col("score") + bonus * F.coalesce("_met", F.lit(0))).alias("score"))

    def title_weighted(self, terms: Sequence[str], weight: float = 3.0) -> DataFrame:
        """(key, score): weight times the title's score and the text's."""
        return self.weighed(terms, {"title": weight, "text": 1.0}).select(self.key, "score")

    def pool(self, terms: Sequence[str], limit: int) -> DataFrame:
        """(key, stage, score): the best documents with all terms first, then those with any (three times limit), the first stage that finds a document counting."""
        terms = list(dict.fromkeys(terms))
        scored = self.weighed(terms, {"text": 1.0})
        order = [F.desc("score"), self.key]
        every = scored.where(F.col("held") == len(terms)).orderBy(*order).limit(limit).select(self.key, F.lit(0).alias("stage"), "score")
        some = scored.orderBy(*order).limit(3 * limit).select(self.key, F.lit(1).alias("stage"), "score")
        return every.unionByName(some).groupBy(self.key).agg(F.min("stage").alias("stage"), F.first("score").alias("score"))

    def match(self, query: str, docs: DataFrame | None = None) -> DataFrame:
        """(key) of the documents that match: words side by side or AND, OR, brackets, "phrases", prefix*, field:part, and ^ before a part that the field begins with.

        AND binds closer than OR. One scan of the postings and one shuffle answer every part: words and prefixes by their presence, phrases and ^ by the places of their words. docs isn't needed, nor read.
        """
        tree, atoms = parse(query, list(self.fields))
        tests = {w: _posting(*w) for a in atoms for w in _words(a)}
        wanted = self.postings.where(reduce(Column.__or__, tests.values(), F.lit(False)))
        if not tests:
            return wanted.select(self.key)
        seen = {w: (F.max(t), f"_a{i}") for i, (w, t) in enumerate(tests.items())}
        rows = {(f, *w[1:]) for a in atoms if _ordered(a) for w in _words(a) for f in w[0]}
        places = {r: (F.flatten(F.collect_list(F.when(_posting((r[0],), *r[1:]), F.col("at")))), f"_p{i}") for i, r in enumerate(sorted(rows))}
        held = wanted.groupBy(self.key).agg(*(c.alias(n) for c, n in (*seen.values(), *places.values())))

        def holds(atom: tuple) -> Column:
            words = _words(atom)
            every = reduce(Column.__and__, (F.col(seen[w][1]) for w in words), F.lit(bool(words)))
            return every & _in_order(atom, lambda *row: F.col(places[row][1])) if _ordered(atom) and words else every

        return held.where(_evaluate(tree, holds)).select(self.key)


def parse(query: str, fields: Sequence[str]) -> tuple[tuple, list[tuple]]:
    """(tree, atoms) of a query. An atom is (fields, kind, text), kind one of word, prefix, phrase and start; a tree is an atom or ("and"/"or", trees)."""
    parts, at = [], 0
    while query[at:].strip():
        m = _PART.match(query, at)
        if not m:
            raise ValueError(f"cannot read the query from {query[at:]!r}")
        parts.append(m)
        at = m.end()
    atoms: list[tuple] = []

    def either(i, where):
        trees, i = _joined(i, where, both, lambda m: m["word"] == "OR")
        return (trees[0] if len(trees) == 1 else ("or", trees)), i

    def both(i, where):
        trees = []
        while i < len(parts) and not parts[i]["close"] and parts[i]["word"] != "OR":
            if parts[i]["word"] == "AND":
                i += 1
                continue
            tree, i = single(i, where)
            trees.append(tree)
        if not trees:
            raise ValueError("a part of the query is empty")
        return (trees[0] if len(trees) == 1 else ("and", trees)), i

    def _joined(i, where, inner, between):
        tree, i = inner(i, where)
        trees = [tree]
        while i < len(parts) and between(parts[i]):
            tree, i = inner(i + 1, where)
            trees.append(tree)
        return trees, i

    def single(i, where):
        m = parts[i]
        if m["open"]:
            tree, i = either(i + 1, where)
            if i >= len(parts):
                raise ValueError("a bracket is not closed")
            return tree, i + 1
        if m["field"]:
            if m["field"] not in fields:
                raise ValueError(f"no field {m['field']}")
            if i + 1 >= len(parts):
                raise ValueError("a field without a part")
            return single(i + 1, (m["field"],))
        start = bool(m["start"])
        i += start
        if i >= len(parts) or (parts[i]["phrase"] is None and parts[i]["word"] is None):
            raise ValueError("^ stands before a word or phrase")
        m = parts[i]
        text = " ".join(re.findall(r"[^\W_]+", (m["phrase"] if m["phrase"] is not None else m["word"]).lower()))
        kind = "start" if start else "prefix" if m["prefix"] else "phrase" if " " in text else "word"
        atoms.append((where, kind, text))
        return atoms[-1], i + 1

    tree, end = either(0, tuple(fields))
    if end < len(parts):
        raise ValueError("a bracket too many")
    return tree, atoms


def _words(atom: tuple) -> list[tuple]:
    """What the postings can say of an atom: (fields, kind, word) that must all be held."""
    where, kind, text = atom
    words = text.split()
    return [(where, "prefix" if kind == "prefix" and i == len(words) - 1 else "word", w) for i, w in enumerate(words)]


def _posting(where: tuple, kind: str, word: str) -> Column:
    return F.col("field").isin(*where) & (F.col("term").startswith(word) if kind == "prefix" else F.col("term") == word)


def _ordered(atom: tuple) -> bool:
    """Whether the places of an atom's words matter."""
    return atom[1] == "start" or " " in atom[2]


def _shifted(places: Column, by: int) -> Column:
    return F.transform(places, lambda x: x - by)


def _in_order(atom: tuple, places) -> Column:
    """Whether a field has an atom's words in a row, at its beginning where the atom asks for that; places(field, kind, word) is an array."""
    where, kind, _ = atom

    def of(field: str) -> Column:
        begins = reduce(F.array_intersect, (_shifted(places(field, *w[1:]), i) for i, w in enumerate(_words(atom))))
        return F.array_contains(begins, 0) if kind == "start" else F.size(begins) > 0

    return reduce(Column.__or__, map(of, where))


def _evaluate(tree: tuple, atom) -> Column:
    if tree[0] not in ("and", "or"):
        return atom(tree)
    return reduce(Column.__and__ if tree[0] == "and" else Column.__or__, (_evaluate(t, atom) for t in tree[1]))
