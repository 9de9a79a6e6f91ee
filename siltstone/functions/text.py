"""Column functions on text: tokens, terms, titles, cleaning."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Words that a query's terms leave out.
STOPWORDS = tuple("a an and are as at be by for from has have how in into is it its of on or that the their this to was what when where which who why will with you your".split())
WORD = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def without_contractions(text: Column) -> Column:
    """won't -> will not, n't -> not, and other endings after an apostrophe dropped."""
    text = F.regexp_replace(text, r"(?i)\bwon['’]t\b", "will not")
    text = F.regexp_replace(text, r"(?i)\bcan['’]t\b", "can not")
    text = F.regexp_replace(text, r"(?i)n['’]t\b", " not")
    return F.regexp_replace(text, r"(?<=\p{L})['’](?:re|ll|ve|d|m|s)\b", "")


def query_terms(text: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Distinct search terms of two characters or more, of the first 512 characters."""
    words = tokens(without_contractions(F.left(text, F.lit(512))))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*stopwords)))


def stem(word: Column) -> Column:
    """Plural, -ing and -ed endings off words of five letters or more that hold no digit."""
    n = F.length(word)
    cut = lambda k: F.left(word, n - k)
    return (
        F.when((n <= 4) | word.rlike("[0-9]"), word).when(word.endswith("ies") & (n > 5), F.concat(cut(3), F.lit("y"))).when(word.endswith("sses"), cut(2))
        .when(word.endswith("ing") & (n > 6), cut(3)).when(word.endswith("ed") & (n > 5), cut(2)).when(word.rlike("[sxz]es$") & (n > 5), cut(2))
        .when(word.rlike("s$") & ~word.rlike("(ss|us|is)$"), cut(1)).otherwise(word)
    )


@pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """NFKC normalisation, which Spark has no function for."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def bare(word: str) -> str:
    """Lower case without any marks."""
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.category(c).startswith("M")).lower()


@pandas_udf(StringType())
def unmarked(text: pd.Series) -> pd.Series:
    """Lower case without any marks, other letters as they are."""
    return text.map(lambda t: None if t is None else bare(t))


@pandas_udf(StringType())
def fold(text: pd.Series) -> pd.Series:
    """Lower case without accents; letters that don't decompose are spelled out."""
    extra = str.maketrans({"đ": "d", "ł": "l", "æ": "ae", "œ": "oe", "ß": "ss", "ø": "o"})
    bare = lambda t: "".join(c for c in unicodedata.normalize("NFD", t.lower()) if not unicodedata.combining(c)).translate(extra)
    return text.map(lambda t: None if t is None else bare(t))


def clean(text: Column) -> Column:
    """Line ends unified, control characters off, runs of blanks and of blank lines shortened, trimmed."""
    text = F.regexp_replace(text, "\r\n?", "\n")
    text = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    text = F.regexp_replace(text, r"[ \t]+", " ")
    return F.trim(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def slug(title: Column, key: Column, most: int = 40) -> Column:
    """An id of lower-case letters, digits and hyphens with a hash of key, so that equal titles stay apart."""
    base = F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.concat_ws("-", F.nullif(F.left(base, F.lit(most)), F.lit("")), F.left(F.sha2(key, 256), F.lit(12)))


def field(text: Column, key: str) -> Column:
    """The value of the first line "key: value" of a listing, null if none."""
    return F.nullif(F.trim(F.regexp_extract(text, rf"(?m)^{key}: (.*)$", 1)), F.lit(""))


def destinations(title: Column) -> Column:
    """Edmonton/South — Huma -> [edmonton, edmonton/south]: the place and the places that hold it."""
    parts = F.split(F.lower(F.trim(F.split(title, " — ")[0])), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def without_lines(text: Column, prefix: str) -> Column:
    """text without the lines that begin with prefix, whatever its case."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: ~F.lower(F.ltrim(line)).startswith(prefix.lower())), "\n")


def plain_html(html: Column) -> Column:
    """Text of HTML: scripts, styles and tags off, the five basic entities decoded, white space shortened."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)>", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(text, r"\s+", " "))
