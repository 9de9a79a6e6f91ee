"""Readers of document files. What one record needs is decided where the record is read; only errors come to the driver, one at most."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.headings import Trail

DOCUMENT = "document_id string, title string, source string, license string, text string"
FIELDS = ("document_id", "title", "source", "license", "text")
ID = re.compile(r"[a-z0-9][a-z0-9._-]{0,127}")
LONGEST = 32 * 1024 * 1024


def _pairs(pairs: list[tuple]) -> dict:
    keys = [k for k, _ in pairs]
    if len(set(keys)) < len(keys):
        raise ValueError(f"field given twice: {next(k for k in keys if keys.count(k) > 1)}")
    return dict(pairs)


def parse_document(line: str) -> tuple[str, ...]:
    """The five fields of a line of JSON, NFKC-normalised, line ends unified, trimmed. Unknown, missing, repeated, blank or other than text fields raise ValueError."""
    if not line.strip():
        raise ValueError("blank line")
    if len(line) > LONGEST:
        raise ValueError("record too long")
    given = json.loads(line, object_pairs_hook=_pairs)
    if not isinstance(given, dict) or set(given) != set(FIELDS):
        raise ValueError(f"fields must be {', '.join(FIELDS)}")
    out = []
    for name in FIELDS:
        if not isinstance(given[name], str):
            raise ValueError(f"{name} is no text")
        text = unicodedata.normalize("NFKC", given[name]).replace("\r\n", "\n").replace("\r", "\n").strip()
        if not text:
            raise ValueError(f"{name} is blank")
        out.append(text)
    if not ID.fullmatch(out[0]):
        raise ValueError(f"bad document_id: {out[0][:140]}")
    return tuple(out)


def parsed(lines: DataFrame, parse: Callable[[str], object], schema: str, column: str = "value", many: bool = False, strict: bool = True) -> DataFrame:
    """Rows that parse makes of each value: a tuple, None for none, or with many an iterable of tuples. ValueErrors raise with the value's beginning if strict, else the value is passed over."""
    names = [f.split()[0] for f in re.split(r",(?![^<]*>)", schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, errors = [], []
            for value in b[column]:
                try:
                    got = parse(value)
                    rows += list(got) if many else [got] if got is not None else []
                except ValueError as e:
                    errors.append(f"{e}: {str(value)[:80]}")
            rows = [(*r, None) for r in rows] + [(*[None] * len(names), e) for e in errors[: strict or 0]]
            yield pd.DataFrame(rows, columns=[*names, "_error"])

    out = lines.select(column).mapInPandas(run, f"{schema}, _error string")
    if strict:
        bad = out.where("_error is not null").select("_error").limit(1).collect()
        if bad:
            raise ValueError(bad[0][0])
    return out.where("_error is null").drop("_error")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents of JSON lines, by id in byte order. Raises ValueError for a line that doesn't hold exactly one valid document, or an id given twice."""
    found = parsed(spark.read.text(path), parse_document, DOCUMENT)
    again = found.groupBy("document_id").count().where("count > 1").limit(1).collect()
    if again:
        raise ValueError(f"document_id given twice: {again[0][0]}")
    return found.orderBy("document_id")


def _cut(text: str, most: int) -> str:
    """text of at most `most` characters, cut after the last sentence end past its half if there is one."""
    if len(text) <= most:
        return text
    at = text.rfind(". ", most // 2, most)
    return text[: at + 1] if at >= 0 else text[:most]


def parse_search_dump(line: str, least_lead: int = 80, body_links: int = 300, body_chars: int = 16_000) -> tuple | None:
    """(page_id, title, lead, body, links, aliases) of an article record of a search dump: main namespace, no disambiguation page, a lead of some length; the body of pages that many link to; at most eight aliases. Action lines and others give None."""
    record = json.loads(line)
    if record.get("namespace") != 0 or "title" not in record or any("disambiguation" in str(t).lower() for t in record.get("template") or []):
        return None
    lead = " ".join(str(record.get("opening_text") or "").split())
    if len(lead) < least_lead:
        return None
    links = int(record.get("incoming_links") or 0)
    aliases = [r["title"] for r in record.get("redirect") or [] if r.get("namespace") == 0][:8]
    body = _cut(str(record.get("text") or ""), body_chars) if links >= body_links else ""
    return int(record.get("page_id") or 0), record["title"], lead, body, links, aliases


def search_dump(spark: SparkSession, path: str, **options) -> DataFrame:
    schema = "page_id long, title string, lead string, body string, links long, aliases array<string>"
    return parsed(spark.read.text(path).where("value != ''"), lambda line: parse_search_dump(line, **options), schema, strict=False)


def fragments(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, text) of <doc id= title=> … </doc> fragment files, split at the closing tag."""
    raw = spark.read.option("lineSep", "</doc>").text(path)
    head = r'(?s)<doc\b[^>]*\bid="([^"]*)"[^>]*\btitle="([^"]*)"[^>]*>(.*)$'
    return raw.where(F.col("value").contains("<doc ")).select(F.regexp_extract("value", head, 1).alias("id"), F.regexp_extract("value", head, 2).alias("title"), F.regexp_replace(F.regexp_extract("value", head, 3), r"^\s+|\s+$", "").alias("text")).where("id != ''")


def markdown_sections(text: str) -> tuple[dict[str, str], list[tuple[str, str]]]:
    """(front matter, [(heading path, text)]) of a Markdown document; headings within fenced code are text."""
    front: dict[str, str] = {}
    m = re.match(r"---\n(.*?)\n---\n", text, re.S)
    if m:
        front = {k.strip(): v.strip() for k, _, v in (line.partition(":") for line in m[1].split("\n")) if k.strip()}
        text = text[m.end() :]
    out, trail, lines, path, fenced = [], Trail(), [], "", False
    for line in [*text.split("\n"), None]:
        h = None if line is None or fenced else re.match(r"(#{1,6})\s+(.*?)\s*#*$", line)
        if line is None or h:
            body = "\n".join(lines).strip()
            if body:
                out.append((path, body))
            lines = []
            if h:
                path = " > ".join(trail.under(len(h[1]), h[2]))
        else:
            fenced ^= line.lstrip().startswith("```")
            lines.append(line)
    return front, out


def markdown(spark: SparkSession, path: str) -> DataFrame:
    """(path, title, license, heading, text) of Markdown files, a row each section."""
    files = spark.read.text(path, wholetext=True).select(F.struct(F.input_file_name().alias("path"), "value").alias("file"))

    def parse(file) -> list[tuple]:
        front, found = markdown_sections(file["value"])
        return [(file["path"], front.get("title", ""), front.get("license", ""), h, t) for h, t in found]

    return parsed(files, parse, "path string, title string, license string, heading string, text string", column="file", many=True)


def answers(spark: SparkSession, path: str) -> DataFrame:
    """(question, text) of question-and-answer files: a line "Q: …" begins a question, the lines up to the next one are its text. Each file's lines stay in order."""
    files = spark.read.text(path, wholetext=True)

    def parse(text: str) -> list[tuple]:
        parts = re.split(r"(?m)^Q: ", text)[1:]
        return [(q.strip(), a.strip()) for q, _, a in (p.partition("\n") for p in parts) if q.strip()]

    return parsed(files, parse, "question string, text string", many=True)


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """(id, embedding) of lines "id<tab>x,y,…"; a component that is no number raises when read."""
    raw = F.split("value", "\t")
    return spark.read.text(path).where("value != ''").select(raw[0].alias("id"), F.transform(F.split(raw[1], ","), lambda x: x.cast("float")).alias("embedding"))


def listings(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, fields) of files of "key: value" blocks parted by blank lines; the first of a repeated key counts."""
    blocks = spark.read.option("lineSep", "\n\n").text(path).where(F.trim("value") != "")

    def parse(text: str) -> tuple | None:
        found: dict[str, str] = {}
        for line in text.strip().split("\n"):
            k, sep, v = line.partition(": ")
            if sep:
                found.setdefault(k.strip(), v.strip())
        return (found.get("Place", ""), found) if found else None

    return parsed(blocks, parse, "title string, fields map<string,string>")
