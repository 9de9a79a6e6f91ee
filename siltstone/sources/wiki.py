"""Wiki dumps: pages of XML, wikitext to plain text, listings and guides."""

from __future__ import annotations

import re
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.chunking import sections
from siltstone.sources.documents import parsed

PAGE = "id long, ns long, title string, redirect struct<_title:string>, revision struct<id:long,text:struct<_VALUE:string>>"


def pages(spark: SparkSession, path: str, namespace: int = 0) -> DataFrame:
    """(page_id, title, text) of a dump's pages of a namespace, redirects left out."""
    raw = spark.read.format("xml").option("rowTag", "page").schema("id long, ns long, title string, redirect string, revision struct<id:long,text:string>").load(path)
    return raw.where((F.col("ns") == namespace) & F.col("redirect").isNull()).select(F.col("id").alias("page_id"), "title", F.col("revision.text").alias("text"))


def templates(text: str) -> list[tuple[int, int]]:
    """(start, end) of outermost {{…}}, nested ones within; brackets without a partner are text."""
    edges = [(m.end(), 1 if m[0] == "{{" else -1) for m in re.finditer(r"\{\{|\}\}", text)]
    depth = list(accumulate((step for _, step in edges), lambda at, step: max(0, at + step), initial=0))
    turns = list(zip(edges, depth, depth[1:], strict=False))
    starts = [end - 2 for (end, _), before, after in turns if before == 0 and after == 1]
    ends = [end for (end, _), before, after in turns if before == 1 and after == 0]
    return list(zip(starts, ends, strict=False))


def fields(template: str) -> tuple[str, dict[str, str]]:
    """(name, named arguments) of one {{name|key=value|…}}; bars within links and inner templates don't part."""
    body, parts, depth = template[2:-2], [""], 0
    for token in re.findall(r"\{\{|\}\}|\[\[|\]\]|\||[^{}\[\]|]+|.", body, re.S):
        depth += token in ("{{", "[[")
        depth -= token in ("}}", "]]")
        if token == "|" and depth == 0:
            parts.append("")
        else:
            parts[-1] += token
    named = {k.strip().lower(): v.strip() for k, sep, v in (p.partition("=") for p in parts[1:]) if sep}
    return parts[0].strip().lower(), named


def plain(text: str, rounds: int = 6) -> str:
    """Wikitext without comments, references, tables, files, templates, links' brackets, tags and emphasis."""
    text = re.sub(r"(?s)<!--.*?-->", "", text)
    text = re.sub(r"(?is)<ref\b[^>]*/>|<ref\b.*?</ref>|<(gallery|math|timeline|mapframe)\b.*?</\1>", "", text)
    text = re.sub(r"(?s)\{\|.*?\|\}", "", text)
    for _ in range(rounds):
        spans = templates(text)
        if not spans:
            break
        for a, z in reversed(spans):
            text = text[:a] + text[z:]
    for _ in range(rounds):
        text, n = re.subn(r"(?i)\[\[(?:file|image|category)\s*:[^\[\]]*\]\]", "", text)
        text, m = re.subn(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", r"\1", text)
        if not n + m:
            break
    text = re.sub(r"\[https?://\S+\s+([^\]]*)\]", r"\1", text)
    text = re.sub(r"\[https?://\S+\]", "", text)
    text = re.sub(r"(?s)<[^<>]*>", "", text)
    text = re.sub(r"'{2,}", "", text)
    text = re.sub(r"(?m)^[*#:;]+\s*", "- ", text)
    return re.sub(r"\n{3,}", "\n\n", text).strip()


LISTED = {"see", "do", "buy", "eat", "drink", "sleep", "listing"}


def listing_documents(title: str, text: str) -> list[tuple[str, str]]:
    """(name, "Key: value" text) of the listing templates of a guide."""
    out = []
    for a, z in templates(text):
        kind, named = fields(text[a:z])
        name = plain(named.get("name", ""))
        if kind not in LISTED or not name:
            continue
        rows = [("Destination", title), ("Category", kind), ("Place", name)]
        rows += [(label, plain(named.get(key, ""))) for label, key in (("Address", "address"), ("Directions", "directions"), ("Hours in source", "hours"), ("Price", "price"), ("Latitude", "lat"), ("Longitude", "long"), ("Description", "content"))]
        out.append((name, "\n".join(f"{k}: {' '.join(v.split())}" for k, v in rows if v)))
    return out


def listings(found: DataFrame) -> DataFrame:
    """(title, place, text) of the listings of pages (title, text)."""
    return parsed(found.select(F.struct("title", "text").alias("p")), lambda p: [(p["title"], n, t) for n, t in listing_documents(p["title"], p["text"] or "")], "title string, place string, text string", column="p", many=True)


def guides(found: DataFrame) -> DataFrame:
    """(title, path, text) of the sections of pages (title, text) in plain text."""
    return parsed(found.select(F.struct("title", "text").alias("p")), lambda p: [(p["title"], h, t) for h, t in ((h, plain(t)) for h, t in sections(p["text"] or "")) if t], "title string, path string, text string", column="p", many=True)
