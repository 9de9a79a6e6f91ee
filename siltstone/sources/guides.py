"""Travel guides in wikitext: templates turned into what they say, sections as documents."""

from __future__ import annotations

import html
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.headings import Trail
from siltstone.operators.chunking import HEADING
from siltstone.sources.documents import parsed

# Names of templates, and what they stand for.
LISTINGS = frozenset("see do eat drink sleep buy go listing vcard".split())
PLACES = frozenset("see do eat drink sleep buy".split())
UNITS = {"km": "km", "mi": "mi", "mile": "miles", "m": "m", "ft": "ft", "kg": "kg", "km/h": "km/h", "mph": "mph", "km2": "km²", "acre": "acres", "c": "°C", "f": "°F"}
SAYING = frozenset(("infobox", "pull quote", "quote", "iata", "icao", "nowrap", "lang", "smallcaps", "sic", "nobr", "flag", "unbulleted list", "station", "phone", "pron"))
BOXES = {"warningbox": "Warning", "cautionbox": "Caution"}
CURRENCIES = frozenset(
    "aed afn all amd ang aoa ars aud awg azn bam bbd bdt bgn bhd bif bmd bnd bob brl bsd btn bwp byn bzd cad cdf chf clp cny cop crc cuc cup cve czk djf dkk dop dzd egp ern etb eur fjd fkp gbp gel ghs gip gmd gnf gtq gyd hkd hnl hrk htg "
    "huf idr ils inr iqd irr isk jmd jod jpy kes kgs khr kmf kpw krw kwd kyd kzt lak lbp lkr lrd lsl lyd mad mdl mga mkd mmk mnt mop mru mur mvr mwk mxn myr mzn nad ngn nio nok npr nzd omr pab pen pgk php pkr pln pyg qar ron rsd rub rwf "
    "sar sbd scr sdg sek sgd shp sle sll sos srd ssp stn svc syp szl thb tjs tmt tnd top try ttd twd tzs uah ugx usd uyu uzs ves vnd vuv wst xaf xcd xof xpf yer zar zmw zwl".split()
)
NO_GUIDE = re.compile(r"\{\{\s*(?:disamb|disambiguation|dab|surname|title index page|vfd|delete|redirect)\b", re.I)
LEAST = 80

_TOKEN = re.compile(r"\{\{|\}\}|\[\[|\]\]|\||[^{}\[\]|]+|.", re.S)
_KEY = re.compile(r"\s*([\w -]+?)\s*=(.*)", re.S)


@dataclass
class Template:
    """A template being read: its parts so far, the first of them its name. Bars within links don't part."""

    parts: list[str] = field(default_factory=lambda: [""])
    links: int = 0

    def add(self, token: str) -> None:
        if token == "|" and not self.links:
            self.parts.append("")
            return
        self.links = max(0, self.links + (token == "[[") - (token == "]]"))
        self.parts[-1] += token

    def said(self, listings: bool) -> str:
        """What it says; nothing if its name has no meaning here."""
        name = self.parts[0].strip().lower().replace("_", " ")
        keyed = [(part, _KEY.fullmatch(part)) for part in self.parts[1:]]
        plain, named = [part.strip() for part, m in keyed if not m], {m[1].lower(): m[2].strip() for _, m in keyed if m}
        say = _SAYS.get(name)
        return say(name, plain, named, listings) if say else ""


def _listing(name: str, plain: list[str], named: dict[str, str], listings: bool) -> str:
    if not listings or not named.get("name"):
        return ""
    about = " ".join(named[k] for k in ("alt", "directions", "content") if named.get(k))
    return f"\n- {named['name']}: {about}\n" if about else f"\n- {named['name']}\n"


def _unit(name: str, plain: list[str], *_) -> str:
    return f"{plain[0]}{'' if UNITS[name][0] == '°' else ' '}{UNITS[name]}" if plain else ""


def _fraction(name: str, plain: list[str], *_) -> str:
    return "" if not plain else f"1/{plain[0]}" if len(plain) == 1 else f"{plain[0]}/{plain[1]}" if len(plain) == 2 else f"{plain[0]} {plain[1]}/{plain[2]}"


def _text(name: str, plain: list[str], named: dict[str, str], listings: bool) -> str:
    return " ".join(filter(None, plain)) or named.get("1", "") or named.get("text", "")


def _box(name: str, plain: list[str], named: dict[str, str], listings: bool) -> str:
    head, text = named.get("boldtext", ""), _text(name, plain, named, listings)
    text = f"{head}. {text}".strip(". ") if head else text
    return f"\n{BOXES[name]}: {text}\n" if text else ""


_SAYS: dict[str, Callable[..., str]] = {
    **dict.fromkeys(LISTINGS, _listing), **dict.fromkeys(CURRENCIES, lambda name, plain, *_: f"{name.upper()} {plain[0] if plain else ''}".strip()), **dict.fromkeys(UNITS, _unit), **dict.fromkeys(SAYING, _text), **dict.fromkeys(BOXES, _box),
    "marker": lambda name, plain, named, _: named.get("name", ""), "convert": lambda name, plain, *_: " ".join(plain[:2]) if len(plain) > 1 else "", "frac": _fraction, "rint": lambda name, plain, *_: plain[-1].upper() if plain else "",
}


def expanded(text: str, listings: bool = True) -> str:
    """Wikitext with each template replaced by what it says, inner ones first, however deep they lie, in one pass. Braces without a partner go, what stands between them stays."""
    open_: list[Template] = []
    out: list[str] = []
    put = lambda token: open_[-1].add(token) if open_ else out.append(token)
    for m in _TOKEN.finditer(text):
        if m[0] == "{{":
            open_.append(Template())
        elif m[0] != "}}":
            put(m[0])
        elif open_:
            said = open_.pop().said(listings)
            if open_:
                open_[-1].parts[-1] += said
            else:
                out.append(said)
    return "".join(out) + "".join("|".join(t.parts) for t in open_)


def _without_files(text: str) -> str:
    """Links to files go with their captions, whatever links those hold."""
    out, at = [], 0
    for m in re.finditer(r"(?i)\[\[\s*(?:file|image)\s*:", text):
        if m.start() < at:
            continue
        out.append(text[at : m.start()])
        depth, at = 0, len(text)
        for edge in re.compile(r"\[\[|\]\]").finditer(text, m.start()):
            depth += 1 if edge[0] == "[[" else -1
            if not depth:
                at = edge.end()
                break
    return "".join([*out, text[at:]])


#: What goes before templates are read, in this order: comments, maps, references, tables, links to files and other wikis.
_BEFORE = tuple(re.compile(p, f) for p, f in (
    (r"<!--.*?(?:-->|\Z)", re.S), (r"<(maplink|mapframe|gallery|graph)\b[^>]*>.*?</\1>", re.S | re.I), (r"<ref[^>/]*/>|<ref[^>]*>.*?</ref>", re.S | re.I), (r"^\{\|.*?^\|\}", re.S | re.M),
    (r"\[\[\s*(?:file|image|category|[a-z]{2,3}(?:-[a-z]+)?)\s*:[^\[\]]*(?:\[\[[^\[\]]*\]\][^\[\]]*)*\]\]", re.I),
))
#: And what is replaced after them: links by their labels, addresses and tags by nothing.
_AFTER = tuple((re.compile(p, re.I), put) for p, put in ((r"\[\[(?:[^\[\]|]*\|)?([^\[\]]*)\]\]", r"\1"), (r"\[(?:https?:)?//\S+(?:\s+([^\]]*))?\]", r"\1"), (r"https?://\S+", ""), (r"</?[a-z][^>]*>", "")))


def readable(text: str, listings: bool = True) -> str:
    """Plain text of a guide's wikitext, its templates said rather than dropped. Lists become lines with a dash; lines of tables and of switches go."""
    for gone in _BEFORE:
        text = gone.sub("", text)
    text = _without_files(expanded(text, listings))
    for found, put in _AFTER:
        text = found.sub(put, text)
    lines = []
    for line in html.unescape(text).replace("'''", "").replace("''", "").split("\n"):
        line = re.sub(r"[ \t\r]+", " ", line).strip()
        bullet = re.match(r"[*#:;]+\s*", line)
        if line.startswith(("__", "|", "!")):
            line = ""
        elif bullet:
            line = f"- {line[bullet.end():]}"
        if line != "- ":
            lines.append(line)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def sections(title: str, text: str, least: int = LEAST) -> list[tuple[int, str, str]]:
    """(number, title — path, text) of a guide's sections with `least` characters or more; the number counts all of them. Listings stay but in sections of places. Redirects, lists of names and pages up for deletion have none."""
    if not text or text.lstrip().lower().startswith("#redirect") or NO_GUIDE.search(text):
        return []
    trail, path, at, cut = Trail(), (), 0, []
    for m in HEADING.finditer(text):
        cut.append((path, text[at : m.start()]))
        path, at = trail.under(min(len(m[1]), 4), readable(m[2], False).strip(" :=")), m.end()
    cut.append((path, text[at:]))
    read = [(n, " > ".join(path) or "Overview", readable(body, not path or path[0].lower() not in PLACES)) for n, (path, body) in enumerate(cut)]
    return [(n, f"{title} — {path}", body) for n, path, body in read if len(body) >= least]


def documents(pages: DataFrame, key: str = "page_id", least: int = LEAST) -> DataFrame:
    """(document_id, title, text) of the sections of pages (key, title, text)."""
    rows = pages.select(F.struct(F.col(key).cast("string").alias("key"), "title", "text").alias("p"))
    return parsed(rows, lambda p: [(f"guide-{p['key']}-{n:04d}", t, body) for n, t, body in sections(p["title"] or "", p["text"] or "", least)], "document_id string, title string, text string", column="p", many=True)
