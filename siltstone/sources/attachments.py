"""Text of attached files: office and e-book archives, XML books, topics, plain text in its encoding."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from siltstone.functions.maths import latex
from siltstone.sources.html import sections as html_sections

LARGEST = 64 * 1024 * 1024
BLOCKS = {"p", "h", "tr", "title", "li", "list-item", "para", "section", "note", "item"}


def decode(raw: bytes) -> str:
    """Bytes as text: by their mark, else UTF-8, else UTF-16 where every other byte is 0, else Windows-1252."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if raw.startswith(mark):
            return raw.decode(name, "replace")
    try:
        return raw.decode()
    except UnicodeDecodeError:
        head = raw[:2000]
        if head[1::2].count(0) > len(head) // 4:
            return raw.decode("utf-16-le", "replace")
        return raw.decode("cp1252", "replace")


def _name(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def _flow(e: ET.Element, out: list[str]) -> None:
    if _name(e) in BLOCKS:
        out.append("\n")
    if e.text:
        out.append(e.text)
    for child in e:
        _flow(child, out)
        if child.tail:
            out.append(child.tail)
    if _name(e) in ("tab",):
        out.append(" ")
    if _name(e) in BLOCKS or _name(e) in ("br", "line-break"):
        out.append("\n")


def xml_text(raw: bytes) -> str:
    """Text of XML, a line for each block; documents with a DTD are refused, as entities could blow them up."""
    if b"<!DOCTYPE" in raw[:4096] or b"<!ENTITY" in raw:
        raise ValueError("document type declarations aren't read")
    parts: list[str] = []
    _flow(ET.fromstring(raw), parts)
    lines = (" ".join(line.split()) for line in "".join(parts).split("\n"))
    return "\n".join(line for line in lines if line)


def _order(name: str) -> list:
    return [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", name)]


def text_of(path: str, raw: bytes) -> str:
    """Text of a file by its ending: docx, pptx, odt, odp, epub, html, xml, else plain text. Archives over a bound, unpacked, raise ValueError."""
    ending = path.rpartition(".")[2].lower()
    if ending in ("docx", "pptx", "odt", "odp", "epub"):
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            if sum(i.file_size for i in z.infolist()) > LARGEST:
                raise ValueError("archive too large")
            names = sorted(z.namelist(), key=_order)
            wanted = {"docx": r"word/document\.xml$", "pptx": r"ppt/slides/slide\d+\.xml$", "odt": r"content\.xml$", "odp": r"content\.xml$", "epub": r".*\.x?html?$"}[ending]
            parts = [z.read(n) for n in names if re.match(wanted, n)]
        if ending == "epub":
            return "\n\n".join(t for p in parts for _, t in html_sections(decode(p)))
        return "\n\n".join(filter(None, map(xml_text, parts)))
    if ending in ("html", "htm"):
        return "\n\n".join(f"{h}\n{t}" if h else t for h, t in html_sections(decode(raw)))
    return xml_text(raw) if ending == "xml" else decode(raw)


def attachments(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, error) of the files of a folder; a file that can't be read has its error, and the others are read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for name, raw in zip(b["path"], b["content"], strict=True):
                try:
                    rows.append((name, text_of(name, bytes(raw)), None))
                except (ValueError, KeyError, ET.ParseError, zipfile.BadZipFile) as e:
                    rows.append((name, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, text string, error string")


def book_sections(raw: bytes, as_latex: bool = False) -> list[tuple[str, str]]:
    """(heading path, text) of an XML textbook module: nested section elements with a title each, in order; mathematics as its text, or as LaTeX between dollars."""
    out: list[tuple[str, str]] = []
    root = ET.fromstring(raw)
    for parent in list(root.iter()) if as_latex else ():
        for e in [c for c in parent if _name(c) == "math"]:
            said = latex(e).strip()
            tail = e.tail
            e.clear()
            e.text, e.tail = f"${said}$" if said else "", tail

    def walk(e: ET.Element, path: tuple[str, ...]) -> None:
        title = next((" ".join("".join(c.itertext()).split()) for c in e if _name(c) == "title"), "")
        path = (*path, title) if title and _name(e) == "section" else path
        own = []
        for c in e:
            if _name(c) in ("section", "content"):
                continue
            if _name(c) not in ("title", "metadata"):
                text = " ".join("".join(c.itertext()).split())
                own += [text] if text else []
        if own:
            out.append((" > ".join(path), "\n".join(own)))
        for c in e:
            if _name(c) in ("section", "content"):
                walk(c, path)

    walk(root, ())
    return out


def topics(raw: bytes, tag: str = "health-topic") -> list[tuple[str, str, str, list[str]]]:
    """(id, title, summary, other names) of a topics file."""
    found = []
    for e in ET.fromstring(raw).iter(tag):
        summary = next((c.text or "" for c in e if _name(c) == "full-summary"), "")
        text = "\n\n".join(t for _, t in html_sections(summary))
        found.append((e.get("id", ""), e.get("title", ""), text, [c.text or "" for c in e if _name(c) == "also-called"]))
    return found
