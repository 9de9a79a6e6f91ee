"""The pipeline's stages against brute-force versions, each on what the stage before it kept."""

from __future__ import annotations

import re
from collections import Counter

import corpus_pipeline
from test_operators import brute_groups, brute_lines, brute_print

from siltstone.llm import decontam, toxicity
from siltstone.llm.common import materialise, table


def shingled(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and blank texts, repeated rows, a long text, clashing names, and no rows at all."""
    names = "doc_id long, text string, n_chars long, _removed string, n_lines long, n_removed long, _key string, _row string, _text string, fp long, ids string, rest string, bands string"
    texts = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (3, "one"), (None, "no id here"), (None, None), (4, "ab cd. " * 9000), (5, "One"), (6, "a\nb\n\na"), (6, "quite another text"), (7, "same words in two rows"), (8, "same words in two rows")]
    docs = spark.createDataFrame([(i, t, None if i == 1 else 5, "x", 1, 2, None, "r", "t", 7, "i", "s", "b") for i, t in texts], names)
    item = "a benchmark passage that is long enough to be found"
    for table_, rows in (("labels", spark.createDataFrame([], "doc_id long, toxic int")), ("benchmark", spark.createDataFrame([(1, item), (None, None)], "item_id long, text string")), ("documents", docs)):
        rows.write.parquet(f"{tmp_path}/{table_}.parquet")
    for given in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, given, str(tmp_path))
            if name != "packing":
                assert out.columns == docs.columns
                out = materialise(out, name)
            rows = out.collect()
            if not given.take(1):
                assert not rows
            elif name == "toxicity":
                assert len(rows) == len(texts)
            elif name == "line_dedup":
                text = Counter((r["doc_id"], r["text"]) for r in rows)
                assert text[3, "one"] == 2 and text[5, ""] == 1 and text[6, "a\nb\n"] == 1 and text[8, ""] == 1 and text[None, "no id here"] == 1 and text[0, None] == 1
                assert all(r["n_chars"] == (None if r["doc_id"] == 1 else 0 if r["text"] == "" else 4 if r["text"] == "a\nb\n" else 5) and r["_removed"] == "x" and r["n_lines"] == 1 for r in rows if r["doc_id"] not in (4,))
            elif name == "near_dedup":
                assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "") for r in rows)[:5] == [(-1, ""), (-1, "no id here"), (0, ""), (3, "one"), (4, rows[[r["doc_id"] for r in rows].index(4)]["text"])]
            elif name == "packing":
                assert {r["doc_id"] for r in rows} == {None, 0, 3, 4, 6, 7}
            given = out


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        after = materialise(stage(spark, docs, sf_dir), name)
        kept[name] = after.collect()
        text = {r["doc_id"]: r["text"] for r in kept[name]} if name != "packing" else {}
        if name != "packing":
            assert after.columns == docs.columns
        if name == "toxicity":
            scorer = toxicity.Scorer(toxicity.learned(docs, table(spark, sf_dir, "labels")))
            assert set(text) == {i for i, r in before.items() if scorer.score(r["text"] or "") < 0.7}
        if name == "line_dedup":
            assert text == brute_lines([(i, r["text"]) for i, r in before.items()])
            assert all(r["n_chars"] == len(r["text"]) for r in kept[name] if r["text"] != before[r["doc_id"]]["text"])
        if name == "near_dedup":
            ids = sorted(before)
            sets = [shingled(before[i]["text"]) for i in ids]
            groups = brute_groups([brute_print(before[i]["text"], 5) for i in ids], 4)
            up = dict(zip(ids, groups, strict=True))
            for i, a in enumerate(sets):
                for j in range(i):
                    if up[ids[i]] != up[ids[j]] and a and len(a & sets[j]) * 100 >= len(a | sets[j]) * 80:
                        old, new = up[ids[i]], up[ids[j]]
                        up = {k: new if g == old else g for k, g in up.items()}
            least = {}
            for i in ids:
                least.setdefault(up[i], i)
            assert set(text) == set(least.values())
        if name == "decontamination":
            items = [t for r in table(spark, sf_dir, "benchmark").collect() if len(t := decontam.normal(r["text"])) >= decontam.Q]
            held = {i for i, r in before.items() if any(decontam.within(t, decontam.normal(r["text"]), decontam.budget(len(t), 0.1)) for t in items)}
            assert set(text) == set(before) - held
        if name == "packing":
            assert {r["doc_id"] for r in kept[name]} == set(before)
            assert max(Counter({r["sequence_id"]: 0 for r in kept[name]}).values()) == 0 and all(r["offset"] + r["length"] <= 4096 for r in kept[name])
        docs = after
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter(map(tuple, (r[:5] for r in whole))) == Counter(map(tuple, (r[:5] for r in kept["packing"])))
