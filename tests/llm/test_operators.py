"""Each operator against a brute-force version, and on rows with nulls, ties, repeats and odd texts."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import types as T

from siltstone.llm import ann, brown, decontam, html, licences, lines, packing, pii, simhash, toxicity
from siltstone.llm.common import components, table

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, key string, term string, kept string, ids string"


def odd(spark):
    """Nulls in any column, empty and blank texts, repeated rows, a very long text, and columns named as the operators' own."""
    long = "x" * 50_000 + " " + "7" * 30_000 + " " + "ab cd. " * 4000
    texts = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (3, "one"), (None, "no id here"), (None, None), (4, long), (5, "one"), (6, "a\nb\n\na"), (7, "It is 10.0.0.1, x@y.org and +1 (555) 123-4567"), (8, "It is 10.0.0.1, x@y.org and +1 (555) 123-4567")]
    return spark.createDataFrame([(i, t, None, "s", None, 1, "k", None, "x", "y") for i, t in texts], DOCS)


def rows(df):
    return [r.asDict() for r in df.collect()]


# ---- 1

def brute_nearest(data, every, k):
    ids = [i for i, _ in data]
    x = np.array([v for _, v in data], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q, i in enumerate(ids):
        if i % every == 0:
            s = x @ x[q]
            out[i] = sorted(((-s[j], ids[j]) for j in range(len(ids)) if ids[j] != i))[:k]
    return out


def test_nearest_recall(spark, sf_dir):
    e = table(spark, sf_dir.replace("sf0.001", "sf0.1"), "embeddings")
    data = [(r["vec_id"], r["embedding"]) for r in e.select("vec_id", "embedding").collect()]
    want = brute_nearest(data, 50, 5)
    got = {}
    for r in ann.nearest(e).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(want)
    hit = sum(len({v for _, v, _ in got[q]} & {v for _, v in w}) for q, w in want.items())
    assert hit >= 0.9 * sum(map(len, want.values()))
    vectors = dict(data)
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5]
        assert all(abs(s - ann.cosine(vectors[q], vectors[v])) < 1e-12 for _, v, s in found)
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)


def test_nearest_odd_rows(spark):
    v = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [float("inf"), 1.0]), (None, [1.0, 1.0]), (9, [1.0, 1.0, 1.0]), (0, [1.0, 0.0]), (10, [])]
    df = spark.createDataFrame([(i, x, "c") for i, x in v], "vec_id long, embedding array<double>, ids string")
    got = [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in ann.nearest(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, 0.0)]
    assert ann.nearest(df.limit(0)).count() == 0
    many = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(120)], "vec_id long, embedding array<double>")
    assert sorted((r["query_id"], r["vec_id"]) for r in ann.nearest(many).collect()) == sorted([(0, i) for i in range(1, 6)] + [(50, i) for i in range(5)] + [(100, i) for i in range(5)])


# ---- 2

PAGE = '<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>T{n}</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">menu {n}</a></li></ul></nav><!-- c --><div class="ad">buy {n}</div><article><h1>Head {n} &amp; co</h1><p><b>Bold {n}<br>next</b>  line\n more<p>Second &lt;{n}&gt;</p></article><footer>&copy; me</footer></body></html>'


def test_main_text(spark):
    pages = [(n, f"https://h.example.com/{n}", PAGE.format(n=n)) for n in range(6)] + [(6, None, None), (7, "x", ""), (None, "https://one.example.org/", PAGE.format(n=9).replace("</article>", "")[:-40])]
    plain = '<html><body><div class="menu">m</div><div class="col">The body of {n} is long text with words</div><div class="comments"><p>first!</p></div></body></html>'
    pages += [(10 + n, f"http://p.example.net/{n}", plain.format(n=n)) for n in range(5)]
    got = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for n in range(6):
        assert got[n] == f"Head {n} & co\nBold {n} next line more\nSecond <{n}>"
    assert got[6] == got[7] == ""
    assert got[None].startswith("Head 9 & co\nBold 9 next line more\nSecond <9>")
    assert got[12] == "The body of 2 is long text with words"
    assert html.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_main_text_of_all_pages(spark, sf_dir):
    for r in html.main_text(table(spark, sf_dir, "pages")).join(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id").collect():
        inside = re.search(r"<article>(.*?)(?:</article>|$)", r["html"], re.S)[1]
        import html as h
        want = "\n".join(t for t in (" ".join(h.unescape(re.sub(r"<[^>]*>|<[^>]*$", " " if False else "", p)).split()) for p in re.split(r"</?(?:h1|p)>", inside.replace("<br>", " "))) if t)
        assert r["text"] == want and r["n_chars"] == len(want)


def unnamed_pages():
    """Two hosts whose elements' names tell nothing: the article is where text varies most."""
    rng = np.random.default_rng(8)
    say = lambda n: " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(n))
    out, want = [], {}
    for h, (top, hold) in enumerate([("xa", "xg"), ("qc", "qi")]):
        for n in range(9):
            parts = [say(int(rng.integers(12, 40))) for _ in range(3 + n % 3)]
            body = "".join(f"<p>{t}</p>" for t in parts)
            links = "".join(f'<li><a href="/{say(1)}">{say(2)}</a></li>' for _ in range(3))
            html_ = f'<html><body><div class="{top}">Welcome to the place</div><div class="{top}b"><ul>{links}</ul></div><div class="xb">{say(2)}</div><div class="{hold}"><div class="xe">Print this text</div>{body}</div><div class="xh">All about us</div></body></html>'
            out.append((100 * h + n, f"http://u{h}.example.com/{n}", html_))
            want[100 * h + n] = "\n".join(parts)
        out += [(100 * h + 50, f"http://u{h}.example.com/odd", "<p>odd page"), (100 * h + 51, f"http://u{h}.example.com/none", None)]
        want |= {100 * h + 50: "odd page", 100 * h + 51: ""}
    return out, want


def test_templates_without_telling_names(spark):
    pages, want = unnamed_pages()
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.main_text(df).collect()}
    assert got == want
    off = {r["page_id"]: r["text"] for r in html.main_text(df, template=False).collect()}
    assert all("Welcome to the place" in off[i] and off[i] != want[i] for i in range(9))


def test_templates_against_whole_vectors(spark):
    pages, _ = unnamed_pages()
    got = {r["host"]: r for r in html.templates(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for h in ("u0.example.com", "u1.example.com"):
        parsed = [html.parse(raw or "") for _, url, raw in pages if html.host(url) == h]
        parsed = [p for p in parsed if p.paths or p.blocks]
        counts = [Counter([*p.paths, *map(html.token, p.blocks)]) for p in parsed]
        vectors = {}
        for t in set().union(*counts):
            vectors.setdefault(tuple(c[t] for c in counts), []).append(t)
        frame = sorted(t for v, ts in vectors.items() if len(ts) > 1 and 2 * sum(x > 0 for x in v) >= len(v) and max(v) == 1 for t in ts)
        assert sorted(got[h]["frame"]) == [t for t in frame if "\t" not in t] and sorted(got[h]["own"]) == [t for t in frame if "\t" in t]
        assert len(got[h]["own"]) == 3 and got[h]["content"].startswith("html/body/div.") and got[h]["content"] in got[h]["frame"]


def test_names_inside_an_article(spark):
    one = '<html><body><article><h1>T</h1><p class="search-results share">kept text here</p><div class="a b c d e f comments"><p>a reader says</p></div></article></body></html>'
    got = html.main_text(spark.createDataFrame([(1, "http://a.example.com/", one)], "page_id long, url string, html string")).first()
    assert got["text"] == "T\nkept text here"


def test_main_text_odd_rows(spark):
    body = "<html><body><article><p>the text of this page</p></article></body></html>"
    rows_ = [(1, "http://a.example.com/1", body, "f", "o"), (1, "http://a.example.com/1", body, "f", "o"), (None, None, body, None, None), (2, None, "<p>" + "w " * 200_000, "x", "y"), (3, "http://a.example.com/3", " ", "x", "y"), (4, "http://a.example.com/4", "<div>" * 3000 + "deep", "x", "y")]
    df = spark.createDataFrame(rows_, "page_id long, url string, html string, frame string, own string")
    got = Counter((r["page_id"], r["n_chars"]) for r in html.main_text(df).collect())
    assert got == Counter({(1, 21): 2, (None, 21): 1, (2, 399_999): 1, (3, 0): 1, (4, 4): 1})
    assert html.main_text(df.limit(0)).count() == 0


# ---- 3

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute_base(text):
    out = {}
    for kind, p in BASE.items():
        out[kind] = []
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (kind == "card" and 16 <= len(d) <= 19 and luhn(d)) or (kind == "phone" and 8 <= len(d) <= 15)
            if ok:
                out[kind].append(m.span())
    return out


TRICKY = [
    "a@b.c_d@e.f x..y@z-1.co.uk. @no.way me@host +49 (30) 1234-567 and +1-2 +1 234 567 8901 2345 6789", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 1.2.3 9999.1.1.1.1",
    "4111 1111 1111 1111, 4111-1111-1111-1112 4111  1111 1111 1111 12 4111111111111111 5500005555555559 6", "😀 x@y.org 😀 10.0.0.1 é+33 1 23 45 67 89é", "user@a.b@c.d user@@a.b %+@-.-", "1" * 400 + " " + "+1" + " 2" * 300,
]


def test_base_spans(spark, sf_dir):
    given = [(i, t) for i, t in enumerate(TRICKY)] + [(None, None), (100, "")]
    docs = spark.createDataFrame(given, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.personal_data(docs).collect()}
    for i, t in given:
        want = brute_base(t)
        assert {k: [tuple(s) for s in got[i][k]] for k in BASE} == want, t


def test_base_digest(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").collect()}
    for r in pii.op3_pii(spark, sf_dir).collect():
        want = brute_base(texts[r["doc_id"]])
        said = ",".join(f"{k}:{a}:{z}" for k in BASE for a, z in want[k])
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest() and r["spans"].startswith(said)
        assert [r[f"n_{k}"] for k in BASE] == [len(want[k]) for k in BASE]


def test_disclosing_terms(spark):
    texts = [f"filler{i} words of doc {i} " * 3 for i in range(40)]
    texts += ["Write to Zebulon Quirke at zq@corp.example.com soon", "Then Zebulon said zq@corp.example.com is right; zebulon again", "Only of doc and words at other@corp.example.com"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [texts[r["doc_id"]][a:z] for a, z in r["term"]] for r in pii.personal_data(docs).collect()}
    assert got[40] == ["Zebulon"] and got[41] == ["Zebulon", "zebulon"] and not got[42] and not any(got[i] for i in range(40))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(docs).collect()}
    assert clean[41] == "Then [TERM] said [EMAIL] is right; [TERM] again" and clean[3] == texts[3]


def test_values_in_rows_without_ids(spark):
    texts = [f"filler{i} words of doc {i} " * 3 for i in range(40)] + ["Zebulon at zq@corp.example.com", "so Zebulon at zq@corp.example.com said"]
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    got = pii.personal_data(docs).collect()
    assert len(got) == 42 and sum(len(r["term"]) > 0 for r in got) == 2


def test_terms_disclose_values_of_one_text(spark):
    texts = [f"filler{i} words of doc {i} " * 3 for i in range(40)]
    gap = "words of doc " * 60
    texts += [f"Quirkeworks {gap} mail ann@corp.example.com", f"mail bob@corp.example.com {gap} at Quirkeworks"]  # far from the values, each in one text
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [texts[r["doc_id"]][a:z] for a, z in r["term"]] for r in pii.personal_data(docs).collect()}
    assert "Quirkeworks" in got[40] and "Quirkeworks" in got[41] and "words" not in got[40] and not any(got[i] for i in range(40))


def test_running_sums(spark):
    from pyspark.sql import functions as F

    n = [i % 7 for i in range(1000)]
    df = spark.createDataFrame([(n,), ([5],)], "a array<int>")
    assert [r[0] for r in df.select(pii.running(F.col("a"))).collect()] == [np.cumsum(n).tolist(), [5]]


# ---- 4

def test_plan_fills_bins():
    rng = np.random.default_rng(3)
    for _ in range(20):
        sizes = Counter(rng.integers(1, 60, 200).tolist())
        used = Counter()
        for times, combination in packing.plan(dict(sizes), 64):
            assert sum(n * k for n, k in combination) <= 64
            for n, k in combination:
                used[n] += k * times
        assert used == sizes
    assert sum(t for t, _ in packing.plan({6: 10, 4: 10}, 10)) == 10


def test_packing(spark, sf_dir):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()] + [(r["doc_id"], r["text"]) for r in odd(spark).collect()]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = packing.pack_documents(df, capacity=512).toPandas()
    want = []
    for i, t in docs:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4").tobytes()
        want += [(i, k, at // 4, len(ids[at : at + 2048]) // 4, zlib.crc32(ids[at : at + 2048])) for k, at in enumerate(range(0, len(ids), 2048))]
    have = [(None if i != i else int(i), int(p), int(s), int(n), int(c)) for i, p, s, n, c in got[["doc_id", "piece", "start", "length", "ids_crc32"]].astype(object).itertuples(index=False)]
    assert Counter(have) == Counter(want)
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == np.r_[0, g["length"].cumsum()[:-1]].tolist() and g["length"].sum() <= 512
    assert got["sequence_id"].nunique() <= math.ceil(got["length"].sum() / 512) + 3
    assert packing.pack_documents(df.limit(0)).count() == 0


# ---- 5

def brute_print(text, k):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(prints, radius):
    up = list(range(len(prints)))

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= radius:
                up[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_simhash(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()]
    docs += [(10_000 + i, docs[i][1] + " Plus one") for i in range(40)]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    prints = [brute_print(t, 4) for _, t in docs]
    groups, least = brute_groups(prints, 4), {}
    for (i, _), g in zip(docs, groups, strict=True):
        least[g] = min(i, least.get(g, i))
    for (i, _), p, g in zip(docs, prints, groups, strict=True):
        assert (got[i]["fp"] & (1 << 64) - 1, got[i]["component_id"]) == (p, least[g])


@pytest.mark.parametrize("n", [30, 700])
def test_tree_search_is_exact(n):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    x = base[rng.integers(0, 12, n)]
    for _ in range(5):
        x = x ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    x = np.unique(x)
    u, v = simhash.shard_links(np.zeros(len(x), np.int64), x, 4)
    at = {int(y): i for i, y in enumerate(x)}
    assert all(int(a) ^ int(b) for a, b in zip(u, v, strict=True))
    groups = brute_groups([int(y) for y in x], 4)
    label = list(range(len(x)))
    for a, b in zip(u, v, strict=True):
        p, q = label[at[int(a)]], label[at[int(b)]]
        label = [min(p, q) if y in (p, q) else y for y in label]
    assert len(set(zip(groups, label, strict=True))) == len(set(groups)) == len(set(label))


def test_trees_prune(spark, sf_dir):
    x = np.unique(simhash.fingerprints(table(spark, sf_dir.replace("sf0.001", "sf0.1"), "documents")).toPandas()["fp"].to_numpy()).view(np.uint64)
    seen = Counter()
    for kept in simhash._shards(len(x), 4):
        key = np.zeros(len(x), dtype=np.int64)
        for shift, width in kept:
            key = (key << width) | ((x >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)
        order = np.argsort(key, kind="stable")
        simhash.shard_links(key[order], x[order], 4, seen)
    assert seen["nodes"] > 100 and seen["leaves"] > seen["nodes"] and seen["pruned"] > seen["compared"]


def test_keep_one_judges_rows(spark):
    a, b, d = "one two three four five six seven eight", "quite another text with words of its own kind here", "yet a third one of no likeness to any of those above"
    docs = spark.createDataFrame([(1, a, 1, "p"), (3, a, 2, "q"), (3, b, 3, "r"), (4, b, 4, "s"), (5, d, 5, "t"), (5, d, 5, "t"), (5, d, 6, "u"), (None, a, 7, "v")], "doc_id long, text string, _gone long, _key string")
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got.collect()) == [(0, a), (1, a), (3, b), (5, d)]


def test_simhash_odd_rows(spark):
    got = simhash.near_duplicates(odd(spark))
    assert got.count() == odd(spark).count()
    by = {(r["doc_id"], r["fp"]): r["component_id"] for r in got.collect()}
    assert by[1, 0] == 0 and by[2, 0] == 0 and by[None, 0] == 0 and by[5, simhash.fingerprint("one") - (1 << 64) if simhash.fingerprint("one") >> 63 else simhash.fingerprint("one")] == 3
    kept = simhash.keep_one(odd(spark))
    assert sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in kept.collect()) == [-1, -1, 0, 3, 4, 6, 7]
    assert kept.columns == odd(spark).columns
    assert simhash.near_duplicates(odd(spark).limit(0)).count() == 0 and simhash.keep_one(odd(spark).limit(0)).count() == 0


def test_keep_one_by_shingles(spark):
    rng = np.random.default_rng(5)
    base = [[f"w{x}" for x in rng.integers(0, 5000, 120)] for _ in range(12)]
    texts = [" ".join(b) for b in base]
    for b in base:
        for edits in (1, 2, 3, 4):  # 0.92 to 0.7: mostly more than 4 bits apart
            w = list(b)
            for at in rng.choice(range(10, 110, 10), edits, replace=False):
                w[at] = f"new{at}"
            texts.append(" ".join(w))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    prints, up = [brute_print(t, 5) for t in texts], list(range(len(texts)))
    far = 0
    for i, a in enumerate(sets):
        for j in range(i):
            alike, bits = len(a & sets[j]) * 100 >= len(a | sets[j]) * 80, (prints[i] ^ prints[j]).bit_count() <= 4
            far += alike and not bits
            if alike or bits:
                up = [min(up[i], up[j]) if x in (up[i], up[j]) else x for x in up]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert far > 10 and {r["doc_id"] for r in simhash.keep_one(docs).collect()} == set(up)


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 99), (99, 99), (7, 7), (None, 3), (200, 201), (201, 202), (202, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 99, 99: 99, 200: 200, 201: 200, 202: 200}


# ---- 6

def brute_lines(docs, percent=80):
    earlier, seen, out = [], set(), {}
    for i, t in sorted((i, t) for i, t in docs if i is not None and t is not None):
        kept = []
        for line in t.split("\n"):
            if not line.split():
                kept.append(line)
                continue
            s = frozenset(line.lower().split())
            if not any(len(s & e) * 100 >= len(s | e) * percent for e in earlier):
                kept.append(line)
            if s not in seen:
                seen.add(s)
                earlier.append(s)
        out[i] = "\n".join(kept)
    return out


def test_lines(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()][:120]
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [[vocabulary[j] for j in rng.integers(0, 60, 14)] for _ in range(25)]
    for i in range(150):  # lines at and about the threshold, in large groups
        made = []
        for _ in range(3):
            w = list(base[rng.integers(0, 25)])
            for _ in range(rng.integers(0, 4)):
                w[rng.integers(0, len(w))] = vocabulary[rng.integers(0, 60)]
            made.append(" ".join(w))
        docs.append((1000 + i, "\n".join(made)))
    got = {r["doc_id"]: r["text"] for r in lines.deduplicate(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_lines(docs)


def test_lines_of_all_lengths(spark):
    docs = []
    for i, n in enumerate([*range(5, 140, 3), 180, 260, 400]):  # each length with shorter and longer lines at and about the threshold
        words = [f"w{i}x{j}" for j in range(n)]
        for k, m in enumerate(sorted({n, n * 9 // 10, math.ceil(n * 5 / 6), math.ceil(n * 4 / 5), n * 4 // 5 - 1})):
            docs += [(1000 * k + i, " ".join(words[:m])), (100_000 - 1000 * k + i, " ".join(words[n // 10 : m] + [f"v{i}x{k}"]))]
    got = {r["doc_id"]: r["text"] for r in lines.deduplicate(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_lines(docs)


def test_lines_odd_rows(spark):
    got = lines.deduplicate(odd(spark))
    assert got.columns == [*odd(spark).columns, "n_lines", "n_removed"]
    have = Counter((r["doc_id"], r["text"]) for r in got.select("doc_id", "text").collect())
    want = Counter((r["doc_id"], r["text"]) for r in odd(spark).collect())
    text = "It is 10.0.0.1, x@y.org and +1 (555) 123-4567"
    want[8, text] -= 1
    want[8, ""] += 1
    want[5, "one"] -= 1
    want[5, ""] += 1
    want[6, "a\nb\n\na"] -= 1
    want[6, "a\nb\n"] += 1
    assert have == +want
    assert lines.deduplicate(odd(spark).limit(0)).count() == 0


# ---- 7

def test_decontamination(spark):
    rng = np.random.default_rng(2)
    say = lambda n: " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(n))
    items = [say(30) for _ in range(30)]
    docs, want = [], set()
    for i in range(60):
        t, n = say(200), int(rng.integers(0, 30))
        if i % 3 == 0:
            passage = list(items[n])
            for _ in range(int(0.09 * len(passage)) if i % 2 else 0):
                passage[rng.integers(0, len(passage))] = "q"
            t = f"{t[:300]}\n{''.join(passage).upper()}! {t[300:]}"
            want.add((i, n))
        docs.append((i, t))
    d = spark.createDataFrame([*docs, (None, None), (99, ""), (100, items[3])], "doc_id long, text string")
    b = spark.createDataFrame([*enumerate(items), (None, "x"), (77, None), (78, "tiny")], "item_id long, text string")
    for chars in (8_000_000, 1500):
        got = decontam.contamination(d, b, chars=chars).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == want | {(100, 3)}
        for r in got:
            if r["doc_id"] < 60:
                assert abs(r["start"] - 301) < 25 and r["similarity"] >= 0.9
        assert sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in decontam.clean(d, b, chars=chars).collect()) == sorted([-1, 99, *({i for i in range(60)} - {i for i, _ in want})])
    assert decontam.contamination(d.limit(0), b).count() == 0 and decontam.clean(d, b.limit(0)).count() == d.count()


def brute_places(pattern, text, k, low=0):
    """Greedy by the whole edit matrix."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern):
        row = _next(row, c, text, i)
    edits = min(row)
    if edits > k or len(text) < len(pattern) - k:
        return []
    end, best = row.index(edits), None
    for start in range(end, max(-1, end - len(pattern) - k - 1), -1):  # the latest start of least distance
        d = list(range(end - start + 1))
        for i, c in enumerate(pattern):
            d = _next(d, c, text[start:end], i)
        if best is None or d[-1] < best[0]:
            best = (d[-1], start)
    start = best[1]
    return [*brute_places(pattern, text[:start], k, low), (edits, low + start, low + end), *brute_places(pattern, text[end:], k, low + end)]


def _next(d, c, text, i):
    out = [i + 1]
    for j, t in enumerate(text):
        out.append(min(d[j] + (t != c), d[j + 1] + 1, out[j] + 1))
    return out


def test_every_occurrence_is_found():
    rng = np.random.default_rng(9)
    say = lambda n: " ".join("".join(chr(97 + c) for c in rng.integers(0, 6, rng.integers(2, 7))) for _ in range(n))
    for _ in range(2):
        items = [say(20), say(4), say(5), say(8), "aa bb aa bb aa bb aa"]
        ix = decontam.index([(i, t) for i, t in enumerate(items) if len(t) >= decontam.Q], 0.1)
        texts = []
        for _ in range(4):
            t = say(12)
            for n in rng.integers(0, len(items), 4):
                p = list(items[n])
                for _ in range(rng.integers(0, 2)):
                    p[rng.integers(0, len(p))] = "z"
                t += " " + " ".join(["".join(p)] * int(rng.integers(1, 4))) + " " + say(int(rng.integers(0, 9)))
            texts.append(decontam.normal(t))
        got = sorted(decontam.occurrences(texts, ix))
        want = sorted((n, i, x, y, e) for n, t in enumerate(texts) for i, (_, p) in enumerate([x for x in enumerate(items) if len(x[1]) >= decontam.Q]) for e, x, y in brute_places(p, t, int(ix.k[i])))
        assert got == want


def test_alignment():
    p = lambda s: np.array([ord(c) for c in s])
    assert decontam.align(p("hello world"), p("xxhello wrldyy"), 2) == (1, 2, 12)
    assert decontam.align(p("hello world"), p("goodbye all"), 3) is None
    rng = np.random.default_rng(4)
    for _ in range(300):
        a, b = ("".join(rng.choice(list("abc"), n)) for n in (rng.integers(1, 9), rng.integers(0, 15)))
        k = int(rng.integers(0, 4))
        assert decontam.within(a, b, k) == (decontam.align(p(a), p(b), k) is not None)


# ---- 8

def test_segments_are_all_maximal():
    rng = np.random.default_rng(1)
    for _ in range(200):
        s = rng.integers(-4, 5, 12).tolist()
        got = toxicity.segments([(i, float(x)) for i, x in enumerate(s)], len(s), 0.0)

        def split(lo, hi):
            best = max(((sum(s[a : z + 1]), -(z - a), -a) for a in range(lo, hi) for z in range(a, hi)), default=(0, 0, 0))
            if best[0] <= 0:
                return []
            a = -best[2]
            z = a - best[1]
            return [*split(lo, a), (a, z, best[0]), *split(z + 1, hi)]

        assert sum(x for _, _, x in got) == pytest.approx(sum(x for _, _, x in split(0, len(s))))
        assert max((x for _, _, x in got), default=0) == max((x for _, _, x in split(0, len(s))), default=0)


def test_toxicity_held_out(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.1")
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, sf, "labels").collect()}
    got = [(r["score"], r["predicted"], labels[r["doc_id"]]) for r in toxicity.op8_toxicity(spark, sf).collect() if r["held_out"] and labels.get(r["doc_id"]) is not None]
    assert all(0 <= s <= 1 and p == (s >= 0.7) for s, p, _ in got)
    hit = sum(p and y for _, p, y in got)
    assert hit >= 0.75 * sum(y for *_, y in got) and hit >= 0.9 * sum(p for _, p, _ in got)


def test_toxicity_odd_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score(odd(spark), toxicity.learned(odd(spark), empty)).collect()
    assert len(got) == odd(spark).count() and all(r["predicted"] == 0 for r in got)
    assert toxicity.rejected(odd(spark), toxicity.Model()).count() == odd(spark).count()


# ---- 9

def test_brown(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()]
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter()
    for i, t in docs:
        if not held(i):
            c.update([*split(t), None])
    n, v = sum(c.values()), len(c)
    gain = []
    df = spark.createDataFrame(docs, "doc_id long, text string")
    train = [d for d in docs if not held(d[0])]
    model, words = brown.train(spark.createDataFrame(train, "doc_id long, text string"), units=200, classes=12, head=500, joined=400)
    assert (model.n, model.v) == (n, v) and len(model.vocabulary.words) <= 500
    got = {r["doc_id"]: r for r in brown.score(df, model, words).collect()}
    full = {r["doc_id"]: r for r in brown.op9_brown(spark, sf_dir).collect()}
    for i, t in docs:
        w = [*split(t), None]
        want = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
        for r in (got[i], full[i]):
            assert (r["n_tokens"], r["n_known"]) == (len(w), sum(c[x] > 0 for x in w))
            assert r["base_score"] == pytest.approx(want, rel=1e-9)
        assert full[i]["held_out"] == held(i) and full[i]["train_tokens"] == n
        if held(i):
            gain.append(full[i]["score"] - want)
    assert sum(gain) > 0
    assert np.allclose((10.0**model.moves).sum(1), 1)
    place = {w: i for i, w in enumerate(model.vocabulary.words)}
    mass = Counter()
    for w, x in c.items():
        if w is not None:
            k = int(model.of[place[w]]) if w in place else model.classes + brown.shape(w)
            mass[k] += (x + (k >= model.classes)) / 10.0 ** model.mass[k]
    assert all(m <= 1 + 1e-9 for m in mass.values()) and sum(k < model.classes for k in model.of[200:400]) > 150
    # the score of each text, from the model's tables alone
    for i, t in docs[:40]:
        last, want = model.classes + brown.SHAPES, 0.0
        for w in split(t):
            k = int(model.of[place[w]]) if w in place else model.classes + brown.shape(w)
            want += model.moves[last, k] + math.log10(c[w] + (place.get(w, 400) >= 400)) - model.mass[k]
            last = k
        want += model.moves[last, model.classes + brown.SHAPES]
        assert got[i]["score"] == pytest.approx(want, rel=1e-9)


def test_words_join_the_classes_of_their_neighbours(spark):
    rng = np.random.default_rng(6)
    groups = [[f"{g}{i}" for i in range(8)] for g in "abcd"]
    rare = {f"{g}rare{i}": n for n, g in enumerate("abcd") for i in range(5)}
    texts = []
    for _ in range(400):
        texts.append(" ".join((list(rare)[5 * n + rng.integers(5)] if rng.random() < 0.08 else groups[n][rng.integers(8)]) for _ in range(6) for n in range(4)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model, _ = brown.train(docs, units=32, classes=4, joined=52)
    at = {w: int(model.of[i]) for i, w in enumerate(model.vocabulary.words)}
    for n, g in enumerate("abcd"):
        assert len({at[w] for w in groups[n]} | {at[f"{g}rare{i}"] for i in range(5)}) == 1
    # the same step by brute force, from whole counts
    known, of = model.vocabulary, model.of.copy()
    of[32:] = model.classes + known.shapes[32:]
    place = {w: i for i, w in enumerate(known.words)}
    size = 4 + brown.SHAPES + 1
    joint, near = np.zeros((size, size)), {}
    for t in texts:
        w = t.split()
        k = [size - 1, *(int(of[place[x]]) for x in w), size - 1]
        for a, b in zip(k, k[1:]):
            joint[a, b] += 1
        for i, x in enumerate(w):
            if place[x] >= 32:
                near.setdefault(x, []).append((k[i], k[i + 2]))
    joint += 0.5
    for x, around in near.items():
        value = [sum(math.log(joint[a, k] / joint[:, k].sum()) + math.log(joint[k, b] / joint[k].sum()) for a, b in around) for k in range(4)]
        assert value[at[x]] >= max(value) - brown.STEP * 2 * len(around)


def test_exchange_finds_classes():
    pairs = np.zeros((40, 40))
    rng = np.random.default_rng(0)
    for _ in range(4000):
        a = rng.integers(0, 10)
        pairs[a, 10 + rng.integers(0, 10)] += 1
        pairs[20 + a, 30 + rng.integers(0, 10)] += 1
    label = brown.exchange(pairs, np.full(40, -1), 4, sweeps=50)

    def information(label):
        n = np.zeros((4, 4))
        np.add.at(n, (label[:, None].repeat(40, 1), label[None].repeat(40, 0)), pairs)
        entropy = lambda x: (x[x > 0] * np.log(x[x > 0])).sum()
        return entropy(n) - entropy(n.sum(0)) - entropy(n.sum(1))

    best = information(label)
    assert best > information(np.arange(40) % 4)
    for w in range(40):
        for k in range(4):
            assert information(np.where(np.arange(40) == w, k, label)) <= best + 1e-6


def test_brown_odd_rows(spark):
    model, words = brown.train(odd(spark).where("doc_id < 4"))
    got = brown.score(odd(spark), model, words)
    assert Counter(r["doc_id"] for r in got.collect()) == Counter(r["doc_id"] for r in odd(spark).collect())
    model, words = brown.train(odd(spark).limit(0))
    assert all(r["n_known"] == 0 and r["base_score"] == 0 for r in brown.score(odd(spark), model, words).collect())
    assert brown.score(odd(spark).limit(0), model, words).count() == 0


# ---- 10

def test_licences(spark):
    say = {
        1: ("Some text.\nLicensed under the Apache License, Version 2.0.\nMore.", "Apache-2.0"), 2: ("# Released under the\n# MIT License.", "MIT"), 3: ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
        4: ("Licensed under CC BY-NC 4.0. Released under the MIT License.", "MIT,CC-BY-NC"), 5: ("I have a driving license. The permission was given.", ""), 6: (None, ""), 7: ("", ""),
        8: ("Permission is hereby granted, free of charge, to any person obtaining a copy of this. The above copyright notice and this permission notice shall be included. THE SOFTWARE IS PROVIDED \"AS IS\", without.", "MIT"),
        9: ("SPDX-License-Identifier: BSD-3-Clause", "BSD-3-Clause"), 10: ("Redistribution and use in source and binary forms, with or without modification, are permitted.", ""),
    }
    got = {r["doc_id"]: r for r in licences.scan(spark.createDataFrame([(i, t) for i, (t, _) in say.items()], "doc_id long, text string")).collect()}
    assert {i: got[i]["licences"] for i in say} == {i: w for i, (_, w) in say.items()}
    assert got[10]["unknown"] == "bsdGrant"
    assert licences.scan(odd(spark)).count() == odd(spark).count()


NOTICES = {
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but without any warranty. You should have received a copy of the GNU General Public License along with this program.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.",
    "LGPL-or-later": "This library is free software: it comes under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0-or-later": "You may use it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the notice appears. The software is provided as it is and the author disclaims all warranties with regard to this software.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. Permission is granted to anyone to use this software for any purpose, including commercial applications. The origin of this software must not be misrepresented. Altered source versions must be plainly marked as such. This notice may not be removed or altered from any source distribution.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted. Redistributions of source code must retain the above copyright notice. Redistributions in binary form must reproduce the above copyright notice.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted. Redistributions of source code must retain the above copyright notice. Redistributions in binary form must reproduce the above copyright notice. Neither the name of the owner nor its contributors' may be used to endorse or promote products.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at the site. Unless required by applicable law or agreed to in writing, software is distributed on an "AS IS" basis. See the License for the specific language governing permissions.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, you can obtain one at the site.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software. The author or authors of this software dedicate any and all copyright interest in the software.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.", "EPL-2.0": "It is made available under the terms of the Eclipse Public License 2.0.", "OFL-1.1": "This font software is licensed under the SIL Open Font License, Version 1.1.", "CC-BY-ND": "Licensed under CC BY-ND 4.0.",
}


@pytest.mark.parametrize("name", NOTICES)
def test_notices(name):
    found, unknown, _ = licences.recognise(f"Some words before.\n\n/* {NOTICES[name]} */\n\nAnd some after.")
    assert found == [name] and not unknown


def test_rules_against_brute_force():
    names = sorted({n for _, row in licences.RULES for n in row})
    rng = np.random.default_rng(4)
    for _ in range(300):
        given = [names[i] for i in rng.integers(0, len(names), 40)]
        left, found = [*enumerate(given)], []
        for licence, row in licences.RULES:
            while True:
                at, taken = -1, []
                for n in row:
                    i = next((i for i, x in left if x == n and i > at), None)
                    if i is None:
                        break
                    taken.append(i)
                    at = i
                if len(taken) < len(row):
                    break
                found.append(licence)
                left = [(i, x) for i, x in left if i not in taken]
        assert licences.match(given) == (found, [x for _, x in left])
    assert len(licences.match(["mitGrant", "asIs"] * 50_000)[0]) == 50_000


def test_long_ids(spark):
    """Ids need not be longs."""
    docs = spark.createDataFrame([("a", "one two three"), ("b", "one two three")], T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("text", T.StringType())]))
    assert [r["component_id"] for r in simhash.near_duplicates(docs).collect()] == ["a", "a"]
