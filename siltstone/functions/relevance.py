"""Column functions that judge a passage against a question's terms, or an answer against its sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.text import bare, stem, tokens, unmarked


def hits(text: Column, terms: Sequence[str]) -> Column:
    """How many terms the text holds; a term of four letters or more also as the beginning of a word."""
    words = tokens(text)
    found = F.lit(0)
    for t in dict.fromkeys(terms):
        found = found + F.exists(words, _starts(t)).cast("int")
    return found


def _starts(term: str):
    return (lambda w: w.startswith(term)) if len(term) >= 4 and term.isalpha() else (lambda w: w == term)


def required(terms: Sequence[str]) -> int:
    """Hits a passage needs: one of up to two terms, two of up to five, three of more."""
    return 1 if len(terms) <= 2 else 2 if len(terms) <= 5 else 3


def relevant(text: Column, terms: Sequence[str], expanded: Sequence[str] = ()) -> Column:
    """Whether a passage has the hits it needs, or one of an expansion of the question."""
    return (hits(text, terms) >= required(terms)) | (hits(text, expanded) > 0 if expanded else F.lit(False))


def boilerplate(text: Column) -> Column:
    """Headings alone, contents lists and navigation: no sentence, or mostly links' separators."""
    marks = F.size(F.split(text, r"[|•·»]")) - 1
    return ~text.rlike(r"[.!?:]") | (F.lower(F.trim(text)).rlike(r"^(contents|table of contents|navigation)\b")) | (marks * 12 > F.length(text))


def scope(title: Column, name: str) -> Column:
    """Whether a title belongs to a place: "name — …" or "name/…", whatever the case and accents."""
    t, n = unmarked(title), bare(name)
    return t.startswith(f"{n} — ") | t.startswith(f"{n}/")


def token_estimate(text: Column) -> Column:
    """Tokens by kinds of characters: four letters, three digits, or one of other signs a token, one at least for each run."""
    part = lambda pattern, n: F.aggregate(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lit(0), lambda s, x: s + F.ceil(F.length(x) / n).cast("int"))
    return part(r"\p{L}+", 4) + part(r"\p{N}+", 3) + part(r"[^\p{L}\p{N}\s]", 1)


def quoted(excerpt: Column, original: Column) -> Column:
    """Whether an excerpt stands in the original, white space aside."""
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.contains(flat(original), flat(excerpt))


def shared_stems(left: Column, right: Column) -> Column:
    """How many word stems of three letters or more two texts share."""
    stems = lambda c: F.array_distinct(F.transform(F.filter(tokens(c), lambda w: F.length(w) >= 3), stem))
    return F.size(F.array_intersect(stems(left), stems(right)))


def figures(text: Column) -> Column:
    """Distinct figures of a text, thousands' separators off."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\d+(?:,\d{3})*(?:\.\d+)?"), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit(""))))


def agrees(stated: Column, source: Column, about: Column | None = None) -> Column:
    """Whether two quantities agree within 2 parts in 100, or 10 where the statement is a rough one."""
    share = F.lit(0.02) if about is None else F.when(about, 0.10).otherwise(0.02)
    return F.abs(stated - source) <= share * F.abs(source)


def refusal(text: Column) -> Column:
    """Whether an answer says that its sources don't tell."""
    return F.lower(text).rlike(r"\b(?:(?:sources|passages|notes|documents) (?:do not|don't) (?:say|mention|state|contain)|not (?:stated|mentioned|found) in the (?:sources|passages|notes)|i (?:do not|don't) know|cannot (?:be )?(?:answer|determine))")


def word_problem(text: Column) -> Column:
    """Whether a question gives three counted numbers or more and asks for arithmetic."""
    return (F.size(F.regexp_extract_all(text, F.lit(r"\d+(?:\.\d+)?\s+\p{L}+"), F.lit(0))) >= 3) & F.lower(text).rlike(r"\bhow (?:many|much|far|long)\b|\btotal\b|\beach\b")


def technical_rule(text: Column, owner: str, symbol: str, literal: str) -> Column:
    """Whether a passage holds an owner, a symbol and a literal, each as a whole token."""
    whole = lambda t: text.rlike(rf"(?<![\w]){_escaped(t)}(?![\w])")
    return whole(owner) & whole(symbol) & whole(literal)


def _escaped(text: str) -> str:
    import re

    return re.escape(text)
