"""Hashed text features and a linear classifier on them."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def fnv1a(text: str, h: int = 2166136261) -> int:
    """32-bit FNV-1a of the UTF-8 bytes; h: that of what stands before text."""
    for byte in text.encode():
        h = (h ^ byte) * 16777619 & 0xFFFFFFFF
    return h


_RUN = fnv1a("c:")


@lru_cache(1 << 16)
def _hashes(word: str, size: int) -> tuple[int, int, tuple[int, ...]]:
    """Of a word: its place among size, the hash of it as the first of a pair, and the places of its runs of 3, 4 and 5 characters, longer ones from the hashes of shorter."""
    framed = f"^{word}$"
    three = [fnv1a(framed[i : i + 3], _RUN) for i in range(len(framed) - 2)]
    four = [fnv1a(c, h) for c, h in zip(framed[3:], three, strict=False)]
    five = [fnv1a(c, h) for c, h in zip(framed[4:], four, strict=False)]
    return fnv1a(f"w:{word}") % size, fnv1a(f"b:{word} "), tuple(h % size for h in (*three, *four, *five))


def features(text: str | None, size: int = 4096) -> dict[int, float]:
    """Hashed counts of words, word pairs and 3- to 5-character runs within words, to length 1. Hashes of words of late are remembered."""
    words = re.findall(r"[^\W_]+", (text or "").lower())
    hashes = [_hashes(w, size) for w in words]
    found = Counter(w for w, _, _ in hashes)
    found.update(fnv1a(b, first) % size for (_, first, _), b in zip(hashes, words[1:], strict=False))
    found.update(chain.from_iterable(runs for _, _, runs in hashes))
    length = math.sqrt(sum(n * n for n in found.values()))
    return {i: n / length for i, n in found.items()}


class Softmax:
    """Multinomial logistic regression with weights quantised to int8."""

    def __init__(self, labels: list[str], size: int = 4096):
        self.labels, self.size = labels, size
        self.weights, self.bias = np.zeros((len(labels), size)), np.zeros(len(labels))

    def fit(self, rows: list[tuple[str, str]], rounds: int = 10, rate: float = 0.5, seed: int = 1) -> Softmax:
        rng = np.random.default_rng(seed)
        data = [(np.array([*f], dtype=int), np.array([*f.values()]), self.labels.index(y)) for t, y in rows if (f := features(t, self.size))]
        for r in range(rounds):
            for n in rng.permutation(len(data)):
                i, x, y = data[n]
                p = self._soft(self.weights[:, i] @ x + self.bias)
                p[y] -= 1
                step = rate / (1 + r)
                self.weights[:, i] -= step * np.outer(p, x)
                self.bias -= step * p * 0.1
        scale = np.abs(self.weights).max(1, keepdims=True) / 127
        self.weights = np.rint(self.weights / np.where(scale > 0, scale, 1)) * scale
        return self

    @staticmethod
    def _soft(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max())
        return e / e.sum()

    def probabilities(self, text: str | None) -> np.ndarray:
        f = features(text, self.size)
        return self._soft(self.weights[:, [*f]] @ np.array([*f.values()]) + self.bias if f else self.bias)

    def score(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """(key, label, p) of every row: the likeliest label."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                p = [self.probabilities(t) for t in b[text]]
                yield pd.DataFrame({key: b[key], "label": [self.labels[int(x.argmax())] for x in p], "p": [float(x.max()) for x in p]})

        return df.select(key, text).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, label string, p double")
