"""Sections of web pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

from siltstone.functions.headings import Trail

SILENT = {"script", "style", "head", "nav", "footer", "aside", "form", "noscript", "template"}
BREAKS = {"p", "div", "li", "tr", "br", "section", "article", "table", "ul", "ol", "dd", "dt", "blockquote"}


class _Sections(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[list] = [[(), []]]
        self.trail = Trail()
        self.silent, self.heading, self.level = 0, None, 0

    def handle_starttag(self, tag, attrs):
        if tag in SILENT:
            self.silent += 1
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.heading, self.level = [], int(tag[1])
        elif tag in BREAKS:
            self.found[-1][1].append("\n")

    def handle_endtag(self, tag):
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif self.heading is not None and tag == f"h{self.level}":
            name = " ".join("".join(self.heading).split())
            self.found.append([self.trail.under(self.level, name), []])
            self.heading = None
        elif tag in BREAKS:
            self.found[-1][1].append("\n")

    def handle_data(self, data):
        if not self.silent:
            (self.found[-1][1] if self.heading is None else self.heading).append(data)


def sections(html: str | None) -> list[tuple[str, str]]:
    """(path of headings, text) in page order, without navigation, forms and scripts; empty sections are left out."""
    parser = _Sections()
    parser.feed(html or "")
    parser.close()
    out = []
    for path, parts in parser.found:
        lines = (" ".join(line.split()) for line in "".join(parts).split("\n"))
        text = "\n".join(line for line in lines if line)
        if text:
            out.append((" > ".join(path), text))
    return out


def html_sections(pages: DataFrame) -> DataFrame:
    """(page_id, n, path, text) of every page's sections."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, n, p, t) for i, h in zip(b["page_id"], b["html"], strict=True) for n, (p, t) in enumerate(sections(h))]
            yield pd.DataFrame(rows, columns=["page_id", "n", "path", "text"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, n int, path string, text string")


class _Tables(HTMLParser):
    """Tables with the level-two heading above them; what is in nested tables belongs to the cell around them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[dict] = []
        self.heading, self.inside, self.depth, self.silent, self.name = "", False, 0, 0, []

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        if tag in ("style", "script", "sup") and (tag != "sup" or "reference" in (given.get("class") or "")):
            self.silent += 1
        elif tag == "h2":
            self.inside, self.name = True, []
        elif tag == "table":
            self.depth += 1
            if self.depth == 1:
                self.found.append({"heading": self.heading, "classes": (given.get("class") or "").split(), "rows": []})
        elif tag == "tr" and self.depth == 1:
            self.found[-1]["rows"].append([])
        elif tag in ("td", "th") and self.depth == 1 and self.found[-1]["rows"]:
            span = lambda key: max(1, int(given.get(key) or 1)) if (given.get(key) or "1").isdecimal() else 1
            self.found[-1]["rows"][-1].append({"text": [], "across": span("colspan"), "down": span("rowspan")})
        elif tag in BREAKS or tag in ("td", "th"):
            self.handle_data(" ")

    def handle_endtag(self, tag):
        if tag in ("style", "script", "sup"):
            self.silent = max(0, self.silent - 1)
        elif tag == "h2" and self.inside:
            self.inside, self.heading = False, " ".join("".join(self.name).split())
        elif tag == "table":
            self.depth = max(0, self.depth - 1)

    def handle_data(self, data):
        if self.silent:
            return
        if self.inside:
            self.name.append(data)
        elif self.depth and self.found[-1]["rows"] and self.found[-1]["rows"][-1]:
            self.found[-1]["rows"][-1][-1]["text"].append(data)


def grid(rows: list[list[dict]]) -> list[list[tuple[str, int]]]:
    """(text, width) of every place of a table: cells stand in each place that they span, and know how many columns they are wide. Places that nothing covers are empty."""
    held: dict[tuple[int, int], tuple[str, int]] = {}
    for i, row in enumerate(rows):
        at = 0
        for cell in row:
            while (i, at) in held:
                at += 1
            text = " ".join("".join(cell["text"]).split())
            held |= {(i + d, at + a): (text, cell["across"]) for d in range(min(cell["down"], len(rows) - i)) for a in range(cell["across"])}
            at += cell["across"]
    width = max((j + 1 for _, j in held), default=0)
    return [[held.get((i, j), ("", 1)) for j in range(width)] for i in range(len(rows))]


def tables(html: str | None) -> list[tuple[str, list[str], list[list[tuple[str, int]]]]]:
    """(heading, classes, grid) of each table of a page that isn't within another."""
    parser = _Tables()
    parser.feed(html or "")
    parser.close()
    return [(t["heading"], t["classes"], grid(t["rows"])) for t in parser.found]


def table_rows(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, n, heading, classes, row, cells, widths): every row of every table of pages (key, html), spans filled in."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, n, head, classes, r, [t for t, _ in row], [w for _, w in row]) for i, h in zip(b[key], b["html"], strict=True) for n, (head, classes, found) in enumerate(tables(h)) for r, row in enumerate(found)]
            yield pd.DataFrame(rows, columns=[key, "n", "heading", "classes", "row", "cells", "widths"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, "html").mapInPandas(run, f"{key} {kind}, n int, heading string, classes array<string>, row int, cells array<string>, widths array<int>")
