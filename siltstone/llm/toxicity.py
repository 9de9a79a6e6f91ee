"""Toxic passages by maximum-scoring segments.

Tokens score the log-odds of toxic against other labelled documents, both smoothed by an informative Dirichlet prior: pseudo-counts in proportion to a token's count in all labelled documents together. A word that isn't telling itself scores as its most telling run of characters, which serves inflected and unseen words. A linear-time scan finds every maximal-scoring segment of a document; the segments beyond what clean text yields by chance, by an extreme-value (Gumbel) fit, add up to the document's score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import materialise, remainder, rows_kept, table

TOKEN = re.compile(r"[^\W_]+")
RUNS, KEPT = (4, 5, 6), 150_000


@dataclass
class Model:
    """weights: log-odds of the telling words, as "=word", and runs of characters; ranks: how sure they are; drift: what any other token costs; scale, place, spread: a segment of score s in a document of n tokens has the calibrated value (scale*s - ln(n+1) - place) / spread; slope, offset: from the document's value to its score."""

    weights: dict[str, float] = field(default_factory=dict)
    ranks: dict[str, float] = field(default_factory=dict)
    drift: float = 0.1
    scale: float = 1.0
    place: float = 0.0
    spread: float = 1.0
    slope: float = 0.0
    offset: float = -3.0


def segments(scores: list[tuple[int, float]], n: int, drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first token, last token, score), in order, of n tokens that cost drift each but for those in scores, (position, score) in order. Linear time: only positive tokens open candidates, and each candidate is merged once."""
    found: list[list[float]] = []  # first, last, sum before it, sum up to its end
    total, at = 0.0, 0
    for i, s in scores:
        total -= drift * (i - at)
        at = i + 1
        before, total = total, total + s
        if s <= 0:
            continue
        new = [i, i, before, total]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = found[j][4] if len(found[j]) > 4 else j - 1
            if j < 0 or found[j][3] >= new[3]:
                new = [*new[:4], j]
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
        found.append(new)
    return [(int(a), int(b), end - start) for a, b, start, end, _ in found]


def features(word: str) -> list[str]:
    """The word itself, and its runs of RUNS characters."""
    return [f"={word}", *(word[i : i + k] for k in RUNS for i in range(len(word) - k + 1))]


class Scorer:
    """Scores of words under a model; those of the last KEPT words are kept."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def word(self, word: str) -> float | None:
        if word not in self.known:
            if len(self.known) >= KEPT:
                self.known.clear()
            ranks, whole = self.model.ranks, f"={word}"
            found = [f for k in RUNS for i in range(len(word) - k + 1) if (f := word[i : i + k]) in ranks]
            if whole in ranks:
                found.append(whole)
            self.known[word] = self.model.weights[max(found, key=lambda f: (ranks[f], f))] if found else None
        return self.known[word]

    def passages(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of tokens, and (start, end, calibrated value) of each segment of the whole text."""
        at, scores, known, word = {}, [], self.known, self.word
        n = 0
        for m in TOKEN.finditer(text):
            t = m[0].lower()
            w = known[t] if t in known else word(t)
            if w is not None:
                scores.append((n, w))
                at[n] = m.span()
            n += 1
        model = self.model
        floor = math.log(n + 1) + model.place
        return n, [(at[a][0], at[b][1], (model.scale * s - floor) / model.spread) for a, b, s in segments(scores, n, model.drift)]

    def score(self, text: str) -> float:
        return squash(value(self.passages(text)[1]), self.model)


def value(found: list[tuple[int, int, float]]) -> float:
    """A document's value: the sum of what its significant segments have beyond chance, else its best segment's value, -9 at least."""
    beyond = sum(s for _, _, s in found if s > 0)
    return min(beyond, 99.0) if beyond > 0 else max([-9.0, *(s for _, _, s in found)])


def squash(v: float, model: Model) -> float:
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, model.slope * v + model.offset))))


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(token, d0, d1, t0, t1): documents and occurrences of each kind."""
    sums: dict[str, list[int]] = {}
    for b in batches:
        for text, toxic in zip(b["text"], b["toxic"], strict=True):
            found: Counter = Counter()
            for w, n in Counter(w.lower() for w in TOKEN.findall(text or "")).items():
                for f in features(w):
                    found[f] += n
            for f, n in found.items():
                s = sums.setdefault(f, [0, 0, 0, 0])
                s[toxic] += 1
                s[2 + toxic] += n
            if len(sums) > 100_000:
                yield pd.DataFrame([(k, *v) for k, v in sums.items()], columns=["token", "d0", "d1", "t0", "t1"])
                sums.clear()
    if sums:
        yield pd.DataFrame([(k, *v) for k, v in sums.items()], columns=["token", "d0", "d1", "t0", "t1"])


def train(docs: DataFrame, labels: DataFrame, max_docs: int = 20_000, prior: float = 0.02, least_z: float = 5.0, least_docs: int = 3, max_tokens: int = 50_000) -> Model:
    """Learns from the labelled rows given (doc_id, toxic 0 or 1; other labels and nulls are left out, and so are ids labelled both ways). The fit reads a bounded sample of them: the max_docs whose hashed id is least.

    prior: the Dirichlet prior's mass, as a share of all counts; a token's pseudo-count is its own share of that. Tokens of least_docs documents or more whose log-odds over documents is least_z of its deviations from 0 or more are telling; at most max_tokens of them, those of largest |z|, are kept. A telling token's score is its smoothed log-odds over occurrences. Without rows of both kinds the model scores everything alike, below 0.7.
    """
    wanted = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("toxic").cast("int").alias("toxic"), F.max("toxic").cast("int").alias("_most")).where("toxic = _most")
    wanted = wanted.select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    rows = materialise(docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id"), "labelled")
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    d0, d1 = sizes.get(0, 0), sizes.get(1, 0)
    model = Model()
    if not d0 or not d1:
        return model
    counts = rows.mapInPandas(_counts, "token string, d0 long, d1 long, t0 long, t1 long").groupBy("token").agg(*(F.sum(c).alias(c) for c in ("d0", "d1", "t0", "t1")))
    size = rows.mapInPandas(lambda it: (pd.DataFrame({"toxic": b["toxic"], "n": [len(TOKEN.findall(t or "")) for t in b["text"]]}) for b in it), "toxic int, n long")
    n = {r["toxic"]: r["n"] or 0 for r in size.groupBy("toxic").agg(F.sum("n").alias("n")).collect()}
    n0, n1 = n.get(0, 0) + 1, n.get(1, 0) + 1

    def log_odds(k: str, all0: int, all1: int) -> tuple[Column, Column]:
        """Smoothed log-odds of kind 1 against kind 0, and its deviation, from counts k0 and k1 of a token in all0 and all1."""
        alpha, mass = F.lit(prior) * (F.col(f"{k}0") + F.col(f"{k}1")), prior * (all0 + all1)
        one, none = F.col(f"{k}1") + alpha, F.col(f"{k}0") + alpha
        odds = F.log(one / (all1 + mass - one + 1)) - F.log(none / (all0 + mass - none + 1))
        return odds, F.sqrt(1 / one + 1 / none)

    (by_docs, deviation), (weight, _) = log_odds("d", d0, d1), log_odds("t", n0, n1)
    scored = counts.where(F.col("d0") + F.col("d1") >= least_docs).withColumn("z", by_docs / deviation).withColumn("w", weight)
    kept = scored.where((F.abs("z") >= least_z) & (F.signum("z") == F.signum("w"))).orderBy(F.desc(F.abs("z")), "token").limit(max_tokens).collect()
    model.weights = {r["token"]: float(r["w"]) for r in kept}
    model.ranks = {r["token"]: abs(float(r["z"])) for r in kept}
    if not any(w > 0 for w in model.weights.values()):
        return model

    def hits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for b in batches:
            yield pd.DataFrame({"toxic": b["toxic"], "n": [sum(scorer.word(w.lower()) is not None for w in TOKEN.findall(t or "")) for t in b["text"]]})

    hit = {r["toxic"]: r["n"] or 0 for r in rows.mapInPandas(hits, "toxic int, n long").groupBy("toxic").agg(F.sum("n").alias("n")).collect()}
    model.drift = max(0.02, math.log((1 - hit.get(0, 0) / n0) / max(1e-3, 1 - hit.get(1, 0) / n1)))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw = Scorer(Model(weights=model.weights, ranks=model.ranks, drift=model.drift))
        for b in batches:
            got = [raw.passages(t or "") for t in b["text"]]
            yield pd.DataFrame({"toxic": b["toxic"], "n": [n for n, _ in got], "parts": [[s for _, _, s in f] for _, f in got]})

    seen = materialise(rows.mapInPandas(measure, "toxic int, n long, parts array<double>"), "segments")
    measured = seen.select("toxic", F.coalesce(F.array_max("parts"), -F.log(F.col("n") + 1)).alias("best")).toPandas()  # two numbers for each of max_docs rows
    best, toxic = measured["best"].to_numpy(), measured["toxic"].to_numpy() == 1
    clean = best[~toxic]
    middle = clean[clean <= np.quantile(clean, 0.98)]  # mislabelled rows aside
    model.spread = max(0.5, float(np.std(middle)) * math.sqrt(6) / math.pi)
    model.place = float(np.mean(middle)) - 0.5772 * model.spread
    model.place += 4 * model.spread  # so that chance exceeds 0 in 2 of 100 clean documents
    parts = F.transform("parts", lambda s: (s - model.place) / model.spread)
    beyond = F.aggregate(F.filter(parts, lambda s: s > 0), F.lit(0.0), lambda s, x: s + x)
    v = F.when(beyond > 0, F.least(beyond, F.lit(99.0))).otherwise(F.greatest(F.coalesce(F.array_max(parts), F.lit(-9.0)), F.lit(-9.0)))
    measured = seen.select("toxic", v.alias("v")).toPandas()
    v, toxic = measured["v"].to_numpy(), measured["toxic"].to_numpy() == 1
    order = np.argsort(-v, kind="stable")
    hit = np.cumsum(toxic[order])
    ends = np.flatnonzero(np.r_[v[order][1:] != v[order][:-1], True])
    f1 = 2 * hit[ends] / (ends + 1 + toxic.sum())
    k = ends[int(np.argmax(f1))]
    low = v[order][k]
    below = v[order][k + 1] if k + 1 < len(v) else low - 1
    cut = (low + below) / 2
    model.slope = 4 / max(0.5, float(np.median(v[toxic])) - cut)
    model.offset = math.log(0.7 / 0.3) - model.slope * cut
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted, passages) for every row: the score of its whole text in 0 to 1, predicted 1 if it is 0.7 or more, and the significant passages (start, end, value) in code points. Null texts count as empty; an empty text scores as one without telling tokens. Repeated rows and null ids are kept; an empty table gives an empty result; texts are read whole, however long; other columns, whatever their names, are ignored."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for b in batches:
            found = [scorer.passages(t or "")[1] for t in b["text"]]
            scores = np.array([squash(value(f), model) for f in found], dtype=float)
            yield pd.DataFrame({
                "doc_id": b["doc_id"], "score": scores, "predicted": (scores >= 0.7).astype("int32"),
                "passages": [[{"start": a, "end": z, "value": s} for a, z, s in f if s > 0] for f in found],
            })

    ids = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {ids}, score double, predicted int, passages array<struct<start:int,end:int,value:double>>")


def learned(docs: DataFrame, labels: DataFrame, held_out: int = 1) -> Model:
    """The model from labels of rows whose crc32(doc_id) mod 3 is not held_out."""
    return train(docs, labels.where(remainder("doc_id", 3) != held_out))


def rejected(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows that the model rejects; all columns stay, whatever their names. Null and empty texts, rows with null ids and repeated rows are judged by their text like any other; empty table: empty result."""

    def keep():
        scorer = Scorer(model)
        return lambda texts: [scorer.score(t or "") < 0.7 for t in texts]

    return rows_kept(docs, keep)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, learned(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return found.select("doc_id", held, "score", "predicted", F.size("passages").alias("n_passages"))
