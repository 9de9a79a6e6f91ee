"""Benchmark decontamination by the q-gram lemma.

Texts are reduced to lower-case words (letters and digits) joined by one space. An occurrence of an item of m characters within k edits shares at least m - q + 1 - k*q q-grams with it, and they all lie within 2k + 1 neighbouring diagonals. Diagonals are counted in bands of that width, taken in pairs that overlap by half, so the diagonals of every occurrence lie in one pair whole. Regions of pairs that reach the bound are joined where they overlap and verified by alignment, again and again beside what is found, so every occurrence is.
"""

from __future__ import annotations

import bisect
import heapq
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import rows_kept, table

WORD = re.compile(r"[^\W_]+")
Q = 8
_BASE, _LONG = 0x9E3779B97F4A7C15, (1 << 64) - 1
CHUNK = 1 << 19
HITS = 1 << 21


def normal(text: str | None) -> str:
    return " ".join(WORD.findall((text or "").lower()))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4").astype(np.uint64)


def grams(points: np.ndarray) -> np.ndarray:
    """Hash of the Q characters at each position."""
    h, width, base = points + np.uint64(1), 1, _BASE
    while width < Q:
        if len(h) <= width:
            return np.empty(0, np.uint64)
        h = h[:-width] * np.uint64(base) + h[width:]
        h ^= h >> np.uint64(29)
        width, base = 2 * width, (base * base | 1) & _LONG
    return h


def budget(m: int, rate: float) -> int:
    """Edits allowed in an item of m characters: rate*m, and so many that the lemma still asks for a shared q-gram."""
    return max(0, min(int(rate * m), (m - Q) // Q))


@dataclass
class Index:
    """A slice of the benchmark: items as (id, text); sorted q-gram hashes; for each, its occurrences."""

    ids: list
    texts: list[str]
    keys: np.ndarray
    first: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    seen: np.ndarray
    k: np.ndarray
    need: np.ndarray
    width: np.ndarray


def index(items: list[tuple], rate: float) -> Index:
    ids, texts = [i for i, _ in items], [t for _, t in items]
    found = [grams(_points(t)) for t in texts]
    size = [len(g) for g in found]
    every = np.concatenate(found) if found else np.empty(0, np.uint64)
    item = np.repeat(np.arange(len(items)), size)
    offset = np.concatenate([np.arange(n) for n in size]) if found else np.empty(0, int)
    order = np.argsort(every, kind="stable")
    keys, first = np.unique(every[order], return_index=True)
    seen = np.zeros(1 << 20, dtype=bool)
    seen[(keys >> np.uint64(44)).astype(np.int64)] = True
    k = np.array([budget(len(t), rate) for t in texts], dtype=np.int64)
    need = np.array([max(1, len(t) - Q + 1 - b * Q) for t, b in zip(texts, k, strict=True)], dtype=np.int64)
    return Index(ids, texts, keys, np.r_[first, len(every)], item[order], offset[order], seen, k, need, 2 * k + 1)


def align(pattern: np.ndarray, region: np.ndarray, k: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best occurrence of pattern in region with k edits at most (the first of the best, the longest start), or None. Columns are the region, a band about the candidate's diagonals."""

    def last_row(p: np.ndarray, t: np.ndarray, anchored: bool) -> np.ndarray:
        at = np.arange(len(t) + 1)
        row = at.copy() if anchored else np.zeros(len(t) + 1, dtype=np.int64)
        for i, c in enumerate(p):
            best = np.minimum(row[:-1] + (t != c), row[1:] + 1)
            row = np.minimum.accumulate(np.r_[i + 1, best] - at) + at
        return row

    row = last_row(pattern, region, False)
    end = int(np.argmin(row))
    if row[end] > k:
        return None
    back = last_row(pattern[::-1], region[:end][::-1], True)
    return int(row[end]), end - int(np.argmin(back)), end


def ends(pattern: str, region: str) -> Iterator[int]:
    """The fewest edits with which pattern ends after each character of region: the bit-parallel form of the alignment's last row, a column of the matrix in two integers."""
    m = len(pattern)
    mask, top, score = (1 << m) - 1, 1 << (m - 1), m
    equal: dict[str, int] = {}
    for i, c in enumerate(pattern):
        equal[c] = equal.get(c, 0) | 1 << i
    up, down, get = mask, 0, equal.get
    for c in region:
        eq = get(c, 0)
        v = eq | down
        h = (((eq & up) + up) ^ up) | eq
        plus = down | (mask & ~(h | up))
        minus = up & h
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        yield score
        plus <<= 1
        up = ((minus << 1) | ~(v | plus)) & mask
        down = plus & v & mask


def within(pattern: str, region: str, k: int) -> bool:
    """Whether pattern occurs in region with k edits at most."""
    return len(pattern) <= k or any(score <= k for score in ends(pattern, region))


def _candidates(points: np.ndarray, ix: Index) -> np.ndarray:
    """(item, band) pairs that hold enough shared q-grams: rows of two columns. Each item has bands as wide as its own edits ask for."""
    g = grams(points)
    at = np.flatnonzero(ix.seen[(g >> np.uint64(44)).astype(np.int64)])
    where = np.searchsorted(ix.keys, g[at])
    where[where == len(ix.keys)] = 0
    same = ix.keys[where] == g[at]
    at, where = at[same], where[same]
    size = ix.first[where + 1] - ix.first[where]
    total = np.cumsum(size)
    keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    shift = int(max((len(t) // w for t, w in zip(ix.texts, ix.width.tolist(), strict=True)), default=0)) + 2
    bands = len(points) // int(ix.width.min(initial=1 << 40)) + shift + 4
    lo = 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + HITS, side="right")))
        n = size[lo:hi]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(ix.first[where[lo:hi]], n)
        item = ix.item[place]
        diagonal = np.repeat(at[lo:hi], n) - ix.offset[place]
        key, count = np.unique(item * bands + diagonal // ix.width[item] + shift, return_counts=True)
        keys, back = np.unique(np.r_[keys, key], return_inverse=True)
        counts = np.bincount(back, weights=np.r_[counts, count], minlength=len(keys)).astype(np.int64)
        lo = hi
    item = keys // bands
    after = np.searchsorted(keys, keys + 1)
    after[after == len(keys)] = 0
    both = counts + np.where(keys[after] == keys + 1, counts[after], 0)
    before = np.searchsorted(keys, keys - 1)
    lone = keys[np.minimum(before, len(keys) - 1)] != keys - 1 if len(keys) else np.empty(0, bool)
    ok = both >= ix.need[item]
    alone = lone & (counts >= ix.need[item])  # the pair that begins with an empty band
    found = [np.c_[item[ok], (keys % bands - shift)[ok]], np.c_[item[alone], (keys % bands - shift - 1)[alone]]]
    return np.unique(np.concatenate(found), axis=0)


def occurrences(texts: list[str], ix: Index) -> Iterator[tuple[int, int, int, int, int]]:
    """(text number, item number, start, end, edits) in reduced texts; every occurrence of an item, of overlapping ones the best."""
    start, chunk, size = 0, [], 0
    for n, t in enumerate([*texts, None]):
        if t is None or (chunk and size + len(t) > CHUNK):
            yield from ((start + a, *rest) for a, *rest in _within(chunk, ix))
            start, chunk, size = n, [], 0
        if t is not None:
            chunk.append(t)
            size += len(t) + Q


def _within(texts: list[str], ix: Index) -> Iterator[tuple[int, int, int, int, int]]:
    if not len(ix.keys):
        return
    gap = "\0" * Q
    whole = gap.join(texts)
    points = _points(whole)
    edge = np.cumsum([0, *(len(t) + Q for t in texts)])
    regions: dict[tuple[int, int], list[list[int]]] = {}
    for item, band in _candidates(points, ix).tolist():
        m, k, width = len(ix.texts[item]), int(ix.k[item]), int(ix.width[item])
        low, high = band * width - k, (band + 2) * width + m + k
        for n in range(max(0, int(np.searchsorted(edge, max(low, 0), side="right")) - 1), min(len(texts), int(np.searchsorted(edge, high, side="left")))):
            a, z = max(low, int(edge[n])), min(high, int(edge[n]) + len(texts[n]))
            if z - a >= m - k:
                have = regions.setdefault((n, item), [])
                if have and a <= have[-1][1]:  # bands come in order
                    have[-1][1] = max(z, have[-1][1])
                else:
                    have.append([a, z])
    for (n, item), parts in sorted(regions.items()):
        found = [f for a, z in parts for f in spans(ix.texts[item], whole, points, a, z, int(ix.k[item]))]
        for edits, x, y in sorted(found, key=lambda f: f[1]):
            yield n, item, x - int(edge[n]), y - int(edge[n]), edits


def spans(pattern: str, whole: str, points: np.ndarray, low: int, high: int, k: int) -> Iterator[tuple[int, int, int]]:
    """(edits, start, end) of the occurrences of pattern in whole[low:high] with k edits at most: the best, of equal ones the first to end, and so on in what lies before and after it.

    Exact ones come first. What lies between them is passed once for the edits at every end; ends are then taken best first, each held against a window no longer than an occurrence can be, so work grows with the text, however often it repeats the pattern.
    """
    edge = low
    while (at := whole.find(pattern, edge, high)) >= 0:
        yield from _inexact(pattern, whole, points, edge, at, k)
        yield 0, at, at + len(pattern)
        edge = at + len(pattern)
    yield from _inexact(pattern, whole, points, edge, high, k)


def _inexact(pattern: str, whole: str, points: np.ndarray, low: int, high: int, k: int) -> Iterator[tuple[int, int, int]]:
    m = len(pattern)
    if not k or high - low < m - k:
        return
    open_ = [(e, low + n) for n, e in enumerate(ends(pattern, whole[low:high]), 1) if e <= k]
    heapq.heapify(open_)
    starts, stops = [high], [low]  # of what is taken, in order, between the region's own ends
    while open_:
        edits, y = heapq.heappop(open_)
        n = bisect.bisect_right(stops, y) - 1
        a = stops[n]
        if y > starts[n] or y - a < m - k:  # taken since, or too little left before it
            continue
        a = max(a, y - m - k)
        now = list(ends(pattern, whole[a:y]))[-1]
        if now > edits:  # its beginning has been taken
            if now <= k:
                heapq.heappush(open_, (now, y))
            continue
        x = a + align(_points(pattern), points[a:y], edits)[1]
        yield edits, x, y
        starts.insert(n, x)
        stops.insert(n + 1, y)


def _original(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of the reduced text as spans of whole words of the text. Words are found in lower case, as reduced texts are made; a character that becomes several in lower case counts for each."""
    at, starts, places, low = 0, [], [], text.lower()
    for m in WORD.finditer(low):
        starts.append(at)
        places.append(m.span())
        at += len(m[0]) + 1
    back = range(len(text)) if len(low) == len(text) else [i for i, c in enumerate(text) for _ in c.lower()]
    word = lambda x: max(0, int(np.searchsorted(starts, x, side="right")) - 1)
    return [(back[places[word(a)][0]], back[places[word(max(a, z - 1))][1] - 1] + 1) for a, z in spans]


def slices(benchmark: DataFrame, rate: float, chars: int) -> Iterator[Index]:
    """Indexes of the benchmark, of about `chars` characters each: the driver holds one slice at a time."""
    items = benchmark.where("item_id is not null and text is not null").select("item_id", "text").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    many = max(1, math.ceil(total / chars))
    for n in range(many):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(many)) == n).orderBy("item_id", "text").collect()
        reduced = [(r["item_id"], normal(r["text"])) for r in part]
        yield index([(i, t) for i, t in reduced if len(t) >= Q], rate)


def contamination(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, chars: int = 8_000_000) -> DataFrame:
    """(doc_id, item_id, start, end, edits, similarity) for each place where a document holds an item within rate*length edits: start and end in code points of the document. Places of one item don't overlap: of overlapping ones the one with fewest edits stands, of equal ones the first to end.

    Items with fewer than Q letters and digits, and null items, are never found; null and empty texts hold none. Repeated rows give repeated rows. Items that occur twice under one id count once; a text under two ids is found under both. Texts of any length are read whole. Other columns of either table, whatever their names, are ignored here and kept by clean(). A benchmark larger than `chars` characters is searched in slices.
    """
    found = None
    for ix in slices(benchmark, rate, chars):
        part = _find(docs, ix, benchmark.schema["item_id"].dataType.simpleString())
        found = part if found is None else found.unionByName(part)
    return found


def _find(docs: DataFrame, ix: Index, item_type: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, ids, rows = b["text"].tolist(), b["doc_id"].tolist(), []
            reduced = [normal(t) for t in texts]
            for n, item, x, y, edits in occurrences(reduced, ix):
                a, z = _original(texts[n], [(x, y)])[0]
                rows.append((ids[n], ix.ids[item], a, z, edits, 1 - edits / len(ix.texts[item])))
            out = pd.DataFrame(rows, columns=["doc_id", "item_id", "start", "end", "edits", "similarity"])
            yield out.astype({"doc_id": b["doc_id"].dtype}) if rows else out

    ids = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {ids}, item_id {item_type}, start int, end int, edits int, similarity double")


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, chars: int = 8_000_000) -> DataFrame:
    """docs without the rows that hold a benchmark item; all columns stay, whatever their names. Null and empty texts hold none and stay, as do rows with null ids; repeated rows go or stay together; empty table: empty result."""
    for ix in slices(benchmark, rate, chars):

        def keep(ix: Index = ix):
            def of(texts: list) -> list[bool]:
                bad = {n for n, *_ in occurrences([normal(t) for t in texts], ix)}
                return [n not in bad for n in range(len(texts))]

            return of

        docs = rows_kept(docs, keep)
    return docs


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
