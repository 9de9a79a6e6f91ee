"""Language-model scoring with Brown class-based n-grams.

The commonest words ("units") are put into classes by exchange clustering on the mutual information of adjacent classes. Each of the words that follow in number ("joined") then makes one step of the same exchange against these classes: it goes to the one with which its neighbours, counted over the whole corpus, have most mutual information. All other words, and those never seen in training, fall into classes by their shape (their last character and length). A text's probability is the product of smoothed class transitions and word emissions. Word counts, neighbours, transitions and emissions cover all training rows.

Texts are read and looked up once; what follows works on their words' numbers, which are written to the shared folder.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import materialise, parts, remainder, table

SHAPES = 12
FLUSH = 300_000
#: Steps of the scores by which words join classes, in natural logarithms.
STEP = 1 / 16


def tokens(text: str | None) -> list[str]:
    """Words of a text: A-Z in lower case, split at ASCII white space. The end token is not among them."""
    return [w.decode("utf-8") for w in (text or "").encode("utf-8", "replace").lower().split()]


def shape(word: str) -> int:
    """0 to SHAPES - 1: the kind of the last character, and the length."""
    last, n = word[-1], len(word)
    kind = 0 if last.isalnum() else 1 if last == "." else 2 if last == "," else 3
    return kind * 3 + (0 if n <= 4 else 1 if n <= 8 else 2)


def counts(docs: DataFrame) -> DataFrame:
    """(token, c) over all rows of docs, without the end token."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for b in batches:
            for t in b["text"]:
                seen.update((t or "").encode("utf-8", "replace").lower().split())
                if len(seen) >= FLUSH:
                    yield pd.DataFrame({"token": [w.decode() for w in seen], "n": [*seen.values()]})
                    seen.clear()
        if seen:
            yield pd.DataFrame({"token": [w.decode() for w in seen], "n": [*seen.values()]})

    return docs.select("text").mapInPandas(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("c"))


def commonest(table_: DataFrame, most: int) -> dict[str, int]:
    """Words with c at or above the lowest power-of-2^(1/8) step that at most `most` words reach. The steps are few, so a histogram of them is all that is gathered."""
    steps = table_.groupBy(F.floor(F.log2("c") * 8).alias("s")).agg(F.count("*").alias("n"), F.min("c").alias("c")).orderBy(F.desc("s")).collect()
    total, least = 0, None
    for r in steps:
        total += r["n"]
        if total > most:
            break
        least = r["c"]
    if least is None:
        return {}
    found = table_.where(F.col("c") >= least).toPandas()
    return dict(sorted(zip(found["token"], (int(c) for c in found["c"]), strict=True), key=lambda x: (-x[1], x[0])))


def exchange(pairs: np.ndarray, fixed: np.ndarray, classes: int, sweeps: int = 20) -> np.ndarray:
    """Classes of units by exchange clustering. pairs[a, b]: how often unit b follows unit a. fixed: a class of its own, numbered from `classes`, for each of the last units, -1 for those to be clustered, the commonest first. Every unit in turn moves to the class that raises the mutual information of adjacent classes most, until a sweep moves none, or for so many sweeps."""
    free = np.flatnonzero(fixed < 0)
    every = classes + int(max(fixed.max(initial=-1) - classes + 1, 0))
    label = np.where(fixed < 0, 0, fixed)
    label[free] = np.arange(len(free)) % classes
    hot = np.zeros((len(label), every))
    hot[np.arange(len(label)), label] = 1
    n = hot.T @ pairs @ hot
    entropy = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)
    for _ in range(sweeps):
        moved = 0
        for w in free:
            g, own = label[w], pairs[w, w]
            right, left = pairs[w] @ hot, pairs[:, w] @ hot
            right[g] -= own
            left[g] -= own
            n[g, :] -= right
            n[:, g] -= left
            n[g, g] -= own
            row, col = n.sum(1), n.sum(0)
            # w in class k: row k gains right, column k gains left, cell k,k gains also own and both meetings
            k = np.arange(classes)
            a, b = n[:classes, :] + right, n[:, :classes] + left[:, None]
            corner = n[k, k] + right[:classes] + left[:classes] + own
            a[k, k] = 0
            b[k, k] = 0
            gain = (entropy(a).sum(1) - entropy(n[:classes, :]).sum(1)) + (entropy(b).sum(0) - entropy(n[:, :classes]).sum(0)) + entropy(corner) + entropy(n[k, k])
            out, into = right.sum() + own, left.sum() + own
            gain -= entropy(row[:classes] + out) - entropy(row[:classes]) + entropy(col[:classes] + into) - entropy(col[:classes])
            best = int(np.argmax(gain))
            if gain[best] <= gain[g] + 1e-9:
                best = int(g)
            n[best, :] += right
            n[:, best] += left
            n[best, best] += own
            if best != g:
                hot[w, g], hot[w, best], label[w] = 0, 1, best
                moved += 1
        if not moved:
            break
    return label


@dataclass
class Vocabulary:
    """words: the commonest, in order; c: their counts; shapes: their shapes; n, v, ends: training tokens, distinct tokens, and end tokens among them."""

    words: list[str]
    c: np.ndarray
    shapes: np.ndarray
    n: int
    v: int
    ends: int


@dataclass
class Model:
    """of: class of each word of the vocabulary; moves[a, b]: log10 P(class b after class a); mass: log10 of each class's emission denominator; classes: how many are no shapes; joined: how many of the words are in those, the commonest."""

    vocabulary: Vocabulary
    of: np.ndarray
    moves: np.ndarray
    mass: np.ndarray
    classes: int
    joined: int

    @property
    def n(self) -> int:
        return self.vocabulary.n

    @property
    def v(self) -> int:
        return self.vocabulary.v


def vocabulary(docs: DataFrame, head: int = 250_000) -> tuple[Vocabulary, DataFrame]:
    """The `head` commonest words of docs, which are what the driver holds, and the written table (token, c) of all words' counts."""
    words = materialise(counts(docs), "counts")
    ends = docs.count()
    v, n = words.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    known = commonest(words, head)
    return Vocabulary([*known], np.array([*known.values()], dtype=np.int64), np.array([shape(w) for w in known], dtype=np.int64), int(n) + ends, int(v) + (ends > 0), ends), words


def encode(docs: DataFrame, known: Vocabulary, *also: Column) -> DataFrame:
    """A written table (_row, doc_id, ids, rest) and the columns also, a row for each of docs: _row tells rows apart; ids are the text's words as numbers, from 0 those of the vocabulary, -1 - shape for others; rest has the others, each with how often it occurs. Null texts count as empty."""
    shared = docs.sparkSession.sparkContext.broadcast({w.encode(): i for i, w in enumerate(known.words)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, other = shared.value.get, {}
        for b in parts(batches):
            ids, ends, rest, often, cuts = [], [0], [], [], [0]
            for t in b.column("text").to_pylist():
                w = (t or "").encode("utf-8", "replace").lower().split()
                x = [*map(get, w)]
                if None in x:
                    left = Counter([a for a, n in zip(w, x, strict=True) if n is None])
                    if len(other) > FLUSH:
                        other.clear()
                    for a in left:
                        if a not in other:
                            other[a] = -1 - shape(a.decode())
                    x = [other[a] if n is None else n for a, n in zip(w, x, strict=True)]
                    rest += left
                    often += left.values()
                ids += x
                ends.append(len(ids))
                cuts.append(len(rest))
            pairs = pa.StructArray.from_arrays([pa.array(rest, pa.binary()).cast(pa.string()), pa.array(often, pa.int32())], names=["token", "tf"])
            made = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pairs)]
            given = [n for n in b.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*map(b.column, given), *made], names=[*given, "ids", "rest"])

    rows = docs.select("doc_id", *also, "text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text")
    coded = rows.mapInArrow(run, f"{kinds}, ids array<int>, rest array<struct<token:string,tf:int>>")
    return materialise(coded.withColumn("_row", F.monotonically_increasing_id()), "coded")


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All words' numbers of a batch's texts, and where each text begins, with the end."""
    column = batch.column("ids")
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.flatten().to_numpy().astype(np.int64), offsets - offsets[0]


def _walk(classes: np.ndarray, edges: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The classes before and after each word; end lies before the first and after the last of a text."""
    before, after = np.full(len(classes), end), np.full(len(classes), end)
    before[1:], after[:-1] = classes[:-1], classes[1:]
    some = edges[:-1] < edges[1:]
    before[edges[:-1][some]] = end
    after[edges[1:][some] - 1] = end
    return before, after


def _adjacent(coded: DataFrame, of: np.ndarray, shapes: int) -> np.ndarray:
    """How often class b follows class a, the end token's class, the last, included. of: class of each word of the vocabulary; shapes: the first shape's class."""
    size, end = shapes + SHAPES + 1, shapes + SHAPES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = np.zeros(size * size, dtype=np.int64)
        for b in parts(batches):
            ids, edges = _flat(b)
            x = np.where(ids >= 0, of[ids], shapes - 1 - ids) if len(of) else shapes - 1 - ids
            before, after = _walk(x, edges, end)
            last = after == end
            pair, n = np.unique(np.r_[before * size + x, x[last] * size + end], return_counts=True)
            got[pair] += n
            got[end * size + end] += int((edges[:-1] == edges[1:]).sum())
        i = np.flatnonzero(got)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(got[i])], names=["pair", "n"])

    found = coded.select("ids").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()  # size^2 rows at most
    pairs = np.zeros(size * size)
    for r in found:
        pairs[r["pair"]] = r["n"]
    return pairs.reshape(size, size)


def join_classes(coded: DataFrame, known: Vocabulary, of: np.ndarray, joint: np.ndarray, classes: int, units: int, joined: int) -> np.ndarray:
    """of, with classes for the words from `units` to `joined`: the class k with the greatest sum over a word's neighbours c of ln n(c, k) / n(k), and of ln n(k, c) / n(k) for those that follow, n being joint, smoothed by a half. Only sums leave a task, a row for each word met there."""
    every, end = len(joint), len(joint) - 1
    smooth = joint + 0.5
    left = np.rint(np.log(smooth[:, :classes] / smooth.sum(0)[:classes]) / STEP).astype(np.int64)
    right = np.rint((np.log(smooth[:classes, :] / smooth.sum(1)[:classes, None]) / STEP).T).astype(np.int64)
    many = joined - units
    names = [f"s{k}" for k in range(classes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((many, classes), dtype=np.int64)
        for b in parts(batches):
            ids, edges = _flat(b)
            x = np.where(ids >= 0, of[ids], classes - 1 - ids)
            before, after = _walk(x, edges, end)
            at = np.flatnonzero((ids >= units) & (ids < joined))
            at = at[np.argsort(ids[at], kind="stable")]
            for lo in range(0, len(at), 16_384):
                part = at[lo : lo + 16_384]
                word, first = np.unique(ids[part], return_index=True)
                sums[word - units] += np.add.reduceat(left[before[part]] + right[after[part]], first, axis=0)
        i = np.flatnonzero(sums.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(i), *(pa.array(sums[i, k]) for k in range(classes))], names=["word", *names])

    found = coded.select("ids").mapInArrow(run, ", ".join(["word long", *(f"{s} long" for s in names)])).groupBy("word").agg(*(F.sum(s).alias(s) for s in names))
    best = F.array_position(F.array(*names), F.greatest(*names)) if classes > 1 else F.lit(1)
    of = of.copy()
    for r in found.select("word", best.cast("int").alias("best")).collect():  # joined rows at most
        of[units + r["word"]] = r["best"] - 1
    return of


def train_coded(coded: DataFrame, known: Vocabulary, words: DataFrame, units: int = 1000, classes: int = 64, joined: int = 65_536, prior: float = 50.0) -> Model:
    """The model of encoded training rows. units: words clustered by exchange; joined: words in classes in all, of those seen more than once; both bound what the driver holds."""
    units = min(units, len(known.words))
    joined = max(units, min(joined, int((known.c > 1).sum())))
    first = np.where(np.arange(len(known.words)) < units, np.arange(len(known.words)), units + known.shapes)
    pairs = _adjacent(coded, first, units)
    label = exchange(pairs, np.r_[np.full(units, -1), classes + np.arange(SHAPES + 1)], classes)
    hot = np.zeros((len(label), classes + SHAPES + 1))
    hot[np.arange(len(label)), label] = 1
    of = classes + known.shapes
    of[:units] = label[:units]
    if joined > units:
        of = join_classes(coded, known, of, hot.T @ pairs @ hot, classes, units, joined)
    joint = _adjacent(coded, of, classes)
    alone = joint.sum(0) + 1
    alone /= alone.sum()
    moves = np.log10((joint + prior * alone) / (joint.sum(1, keepdims=True) + prior))

    def types(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = np.zeros(SHAPES, dtype=np.int64)
        for b in batches:
            got += np.bincount([shape(w) for w in b["token"]], minlength=SHAPES).astype(np.int64)
        yield pd.DataFrame({"shape": np.arange(SHAPES), "n": got})

    kinds = np.zeros(len(joint))
    for r in words.select("token").mapInPandas(types, "shape int, n long").groupBy("shape").agg(F.sum("n").alias("n")).collect():
        kinds[classes + r["shape"]] = r["n"]
    kinds[classes : classes + SHAPES] += 1 - np.bincount(known.shapes[:joined], minlength=SHAPES)  # each known word, and unseen words together, get one more
    mass = np.log10(np.maximum(joint.sum(0) + kinds, 1))
    return Model(known, of, moves, mass, classes, joined)


def train(docs: DataFrame, units: int = 1000, classes: int = 64, head: int = 250_000, joined: int = 65_536, prior: float = 50.0) -> tuple[Model, DataFrame]:
    """The model of docs, and the written table (token, c) of all words' counts. units, classes, head and joined bound what the driver holds; everything is counted over all of docs. Null texts count as empty; repeated rows count as often as they come; null ids don't matter; an empty table gives a model that knows no word; other columns are ignored."""
    known, words = vocabulary(docs, head)
    return train_coded(encode(docs, known), known, words, units, classes, joined, prior), words


def score_coded(coded: DataFrame, model: Model, words: DataFrame, *also: str) -> DataFrame:
    """score() of encoded rows, with the columns also."""
    known = model.vocabulary
    shared = coded.sparkSession.sparkContext.broadcast((known.c, model.of, model.moves, model.mass))
    first, joined, ends = model.classes, model.joined, known.ends
    end, every = first + SHAPES, known.n + known.v + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, of, moves, mass = shared.value
        log, more = np.log10(np.maximum(c, 1)), np.log10(c + 1)
        for b in parts(batches):
            ids, edges = _flat(b)
            seen = ids >= 0
            at = np.where(seen, ids, 0)
            x = np.where(seen, of[at], first - 1 - ids) if len(c) else first - 1 - ids
            before, after = _walk(x, edges, end)
            n = edges[1:] - edges[:-1]
            base = np.where(seen, more[at], 0.0) if len(c) else np.zeros(len(ids))
            emitted = np.where(seen, np.where(ids < joined, log[at], more[at]), 0.0) if len(c) else np.zeros(len(ids))
            value = moves[before, x] + emitted - mass[x] + np.where(after == end, moves[x, end], 0.0)
            total = lambda v: np.diff(np.r_[0, np.cumsum(v)][edges])
            whole = total(value) + np.where(n == 0, moves[end, end], 0.0)
            names = ["_row", "n_tokens", "known", "base", "total"]
            known_ = total(seen.astype(np.int64)) + (ends > 0)
            base = total(base) + math.log10(ends + 1) - (n + 1) * math.log10(every)
            yield pa.RecordBatch.from_arrays([b.column("_row"), pa.array(n + 1), pa.array(known_.astype(np.int64)), pa.array(base), pa.array(whole)], names=names)

    sums = coded.select("_row", "ids").mapInArrow(run, "_row long, n_tokens long, known long, base double, total double")
    rest = coded.select(F.col("_row").alias("_of"), F.explode("rest").alias("r")).select("_of", "r.token", "r.tf")
    met = rest.join(words.select(F.col("token").alias("_token"), "c"), F.col("token") == F.col("_token"))
    tail = met.groupBy("_of").agg(F.sum("tf").alias("tail_known"), F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("tail"))
    ids = coded.select(F.col("_row").alias("_id"), "doc_id", *also)
    joined_ = ids.join(sums, F.col("_id") == F.col("_row")).join(tail, F.col("_row") == F.col("_of"), "left")
    added = F.coalesce("tail", F.lit(0.0))
    total = F.col("total") + added
    return joined_.select(
        "doc_id", *also, "n_tokens", (F.col("known") + F.coalesce("tail_known", F.lit(0))).cast("long").alias("n_known"), (F.col("base") + added).alias("base_score"), total.alias("score"),
        F.pow(F.lit(10.0), -total / F.col("n_tokens")).alias("perplexity"),
    )


def score(docs: DataFrame, model: Model, words: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score, perplexity) for every row of docs.

    Null texts count as empty, which has the end token alone. Repeated rows give repeated rows; a null doc_id is a value like any other. Texts are read whole, however long. An empty table gives an empty result; other columns, whatever their names, are ignored. Words outside the model's vocabulary are joined to their counts.
    """
    return score_coded(encode(docs, model.vocabulary), model, words)


def op9_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(remainder("doc_id", 7) == 2, F.lit(False))
    known, words = vocabulary(docs.where(~held))
    coded = encode(docs, known, held.alias("held_out"))
    found = score_coded(coded, train_coded(coded.where("not held_out"), known, words), words, "held_out")
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(known.n).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")
