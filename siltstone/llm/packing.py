"""Best-fit packing of tokenised documents by minimum bin slack.

Lengths are bounded by the sequence length, so the multiset of all pieces is a histogram of that many counts at most, whatever the corpus: the plan is made on it. For each bin, subset sums over the available lengths, kept as a bitset, show the fullest feasible combination with the longest piece left; it is taken as often as the counts allow. The plan's rows are then dealt to the pieces by their rank among pieces of equal length, and the ranks come from counts by bucket, so that no length is gathered in one task.
"""

from __future__ import annotations

import gc
import json
import os
import re
import sys
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.llm.common import materialise, table

END = 1
#: White space that str.split() and the vocabulary's pre-tokeniser may see differently.
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
assert array("I").itemsize == 4 and sys.byteorder == "little"
_loaded: dict[str, _Encoder] = {}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: The normaliser and pre-tokeniser under which a text is its words' runs, each encoded alone.
_RUN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PLAIN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": _RUN}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "post_processor": None,
}
#: Words beyond these characters, and those with a sigma, whose small letter depends on its place, are left to the tokeniser whole.
_LATIN = re.compile("[\x21-\u024f]+")
_LATIN_LINES = re.compile("[\n\x21-\u024f]*")


class _Encoder:
    """Texts to their ids as little-endian unsigned 32-bit.

    Where the vocabulary drops white space and marks the ends of runs, a text is its words, a word its runs of letters or marks. Up to `cached` words and `run_cached` runs are kept. New runs are encoded many at a time, joined by spaces, and the ends of runs cut the result. Words with characters outside Latin, and texts with special tokens or other than plain white space, are encoded whole, as are all texts under other vocabularies.
    """

    def __init__(self, path: str, cached: int = 1_200_000, run_cached: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        given = json.loads(open(path, encoding="utf-8").read())
        self.model, self.cached, self.run_cached, self.words, self.runs = Tokenizer.from_file(path), cached, run_cached, {}, {}
        self.plain = all(given.get(k) == v for k, v in _PLAIN.items()) and given["model"].get("end_of_word_suffix") == "</w>"
        self.special = [t["content"] for t in given["added_tokens"]]
        self.cut = regex.compile(_RUN).findall
        self.ends = np.zeros(1 + max([*given["model"]["vocab"].values(), *(t["id"] for t in given["added_tokens"])]), dtype=bool)
        self.ends[[i for t, i in given["model"]["vocab"].items() if t.endswith("</w>")]] = True

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def learn_runs(self, new: list[str], many: int = 256) -> None:
        for at in range(0, len(new), many):
            part = new[at : at + many]
            ids = np.array(self.model.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
            raw = ids.tobytes()
            parts = [raw[a:z] for a, z in zip([0, *ends.tolist()], ends.tolist(), strict=False)] if len(ends) == len(part) else self.whole(part)
            self.runs.update(zip(part, parts, strict=True))

    def learn(self, new: list[str]) -> None:
        odd = [] if _LATIN_LINES.fullmatch("\n".join(new)) else [w for w in new if not _LATIN.fullmatch(w)]
        if odd:
            new = list(set(new).difference(odd))
        small, apart = unicodedata.normalize("NFC", "\n".join(new)).lower().split("\n") if new else [], []
        for w in small:
            core = w.rstrip(".,;:!?")
            if core.isalpha():  # the common cases of the pattern: one run of letters, or one and marks
                apart.append((core,) if len(core) == len(w) else (core, w[len(core) :]))
            else:
                apart.append(self.cut(w))
        self.words.update(zip(odd, self.whole(odd), strict=True))
        every = set(chain.from_iterable(apart))
        runs = list(every.difference(self.runs))
        if len(self.runs) + len(runs) > self.run_cached:
            self.runs.clear()
            runs = list(every)
        self.learn_runs(runs)
        get = self.runs.__getitem__
        self.words.update((w, get(r[0]) if len(r) == 1 else get(r[0]) + get(r[1]) if len(r) == 2 else b"".join(map(get, r))) for w, r in zip(new, apart, strict=True))

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        odd, special, hint = _ODD.search if self.plain else bool, self.special, os.path.commonprefix(self.special)
        for at in range(0, len(texts), 512):
            words = [None if odd(t) or hint in t and any(s in t for s in special) else t.split() for t in texts[at : at + 512]]
            flat = list(chain.from_iterable(w for w in words if w))
            ids = list(map(self.words.get, flat))
            new = list({w for w, i in zip(flat, ids, strict=True) if i is None})
            if len(self.words) + len(new) > self.cached:
                self.words.clear()
            self.learn(new)
            get, first = self.words.__getitem__, 0
            ids = [get(w) if i is None else i for w, i in zip(flat, ids, strict=True)]
            for t, w in zip(texts[at : at + 512], words, strict=True):
                if w is None:
                    yield self.whole([t])[0]
                else:
                    yield b"".join(ids[first : first + len(w)])
                    first += len(w)


def _tokenizer(path: str, cached: int = 1_200_000) -> _Encoder:
    if path not in _loaded:
        _loaded[path] = _Encoder(path)
    _loaded[path].cached, _loaded[path].run_cached = cached, cached * 5 // 6
    return _loaded[path]


def pieces(docs: DataFrame, path: str, capacity: int = 4096, cached: int = 1_200_000) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every text's ids and the end id, cut into pieces of at most capacity ids; only the last of a text may be shorter."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, end = _tokenizer(path, cached), np.array([END], dtype="<u4").tobytes()
        gc.disable()  # millions of strings, and no cycles among them
        for b in batches:
            rows = []
            for doc, raw in zip(b["doc_id"], ids([t or "" for t in b["text"]]), strict=True):
                raw += end
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": b["doc_id"].dtype})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(number of bins, [(length, pieces of it in each bin)]) by minimum bin slack, until the histogram is empty."""
    left = {n: c for n, c in histogram.items() if c > 0}
    lengths = sorted(left, reverse=True)
    out = []
    while lengths:
        first = lengths[0]
        room, reach, steps = capacity - first, 1, []
        full = 1 << room
        mask = (full << 1) - 1
        for n in lengths:
            if n > room:
                continue
            many, part = min(left[n] - (n == first), room // n), 1
            while many > 0:  # 1, 2, 4, ... copies: any number of copies up to many
                k = min(part, many)
                steps.append((n, k, reach))
                reach |= (reach << (n * k)) & mask
                many -= k
                part *= 2
            if reach & full:
                break
        at = reach.bit_length() - 1
        used = {first: 1}
        for n, k, before in reversed(steps):
            if not before >> at & 1:
                used[n] = used.get(n, 0) + k
                at -= n * k
        times = min(left[n] // k for n, k in used.items())
        out.append((times, sorted(used.items(), reverse=True)))
        for n, k in used.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
                lengths.remove(n)
    return out


def pack(cut: DataFrame, capacity: int = 4096, bucket_rows: int = 20_000) -> DataFrame:
    """cut: a written table with columns length (1 to capacity) and _row, a number of its own for each row; returns it, without _row, with sequence_id and offset. Pieces of one sequence lie gapless from offset 0 and have capacity ids at most together. Empty table: empty result."""
    histogram = {int(r["length"]): int(r["count"]) for r in cut.groupBy("length").count().collect()}  # capacity rows at most
    rows, base, taken = [], 0, dict.fromkeys(histogram, 0)
    for times, combination in plan(histogram, capacity):
        at = 0
        for n, k in combination:
            rows.append((n, taken[n], base, k, at))
            taken[n] += k * times
            at += n * k
        base += times
    by_length = {}
    for n, rank, first_bin, k, at in rows:
        by_length.setdefault(n, []).append((rank, first_bin, k, at))
    tables = {n: np.array(v, dtype=np.int64) for n, v in by_length.items()}
    buckets = max(1, sum(histogram.values()) // bucket_rows)
    dealt = cut.withColumn("_bucket", F.pmod(F.xxhash64("_row"), F.lit(buckets)))
    counts = dealt.groupBy("_bucket", "length").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("length").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_bucket", "length", before.alias("_before"))
    ranked = dealt.withColumn("_rank", F.row_number().over(W.partitionBy("_bucket", "length").orderBy("_row")) - 1)
    ranked = ranked.join(counts, ["_bucket", "length"]).withColumn("_rank", (F.col("_rank") + F.col("_before")).cast("long"))
    fields = [f for f in cut.schema.fields if f.name != "_row"]
    ranked = ranked.select(*(f.name for f in fields), "_rank")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sequence, offset = np.empty(len(b), np.int64), np.empty(len(b), np.int64)
            lengths, rank = b["length"].to_numpy(), b["_rank"].to_numpy()
            for n in np.unique(lengths):
                i, t = np.flatnonzero(lengths == n), tables[int(n)]
                row = t[np.searchsorted(t[:, 0], rank[i], side="right") - 1]
                nth = rank[i] - row[:, 0]
                sequence[i] = row[:, 1] + nth // row[:, 2]
                offset[i] = row[:, 3] + nth % row[:, 2] * n
            yield b.drop(columns="_rank").assign(sequence_id=sequence, offset=offset)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return ranked.mapInPandas(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = 4096, cached: int = 1_200_000) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for all of docs. Null and empty texts have the end id alone. Repeated rows and null ids are packed like any other; texts of any length are cut, whole; other columns, whatever their names, are ignored; an empty table gives an empty result. cached: words whose ids a worker keeps; it changes time and memory only."""
    return pack(materialise(pieces(docs, path or tokenizer_path(), capacity, cached).withColumn("_row", F.monotonically_increasing_id()), "pieces"), capacity)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
