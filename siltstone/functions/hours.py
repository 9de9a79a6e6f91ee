"""Opening hours as ranges of minutes of a week.

Hours as maps and guides write them are read once, into a timeline: when a place is open, and when nobody knows. Everything asked of a timeline (the state at a minute, in a part of a day, minutes open) is arithmetic on its ranges in column functions.

A range is (at, to, until): minutes from Monday 00:00, to exclusive and past the week's end where hours run into Monday; until is the minute of the day at which it closes, null for an open end.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, types
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

DAY, WEEK = 1440, 7 * 1440
DAYS = ("mo", "tu", "we", "th", "fr", "sa", "su")
RANGES = types.ArrayType(types.StructType([types.StructField(n, types.IntegerType()) for n in ("at", "to", "until")]))
TIMELINE = types.StructType([types.StructField("open", RANGES), types.StructField("unsure", RANGES)])

_D = rf"(?:{'|'.join(DAYS)})"
_ITEM = rf"(?:{_D}(?:\s*-\s*{_D})?|(?:ph|sh))\b"
_TIME = r"\d{1,2}:\d{2}"
_HOURS = rf"(?:{_TIME}\s*-\s*{_TIME}\+?|{_TIME}\+)"
_RULE = re.compile(rf"(?P<days>{_ITEM}(?:\s*,\s*{_ITEM})*)?\s*(?P<what>off|closed|24/7|{_HOURS}(?:\s*,\s*{_HOURS})*)")
_FROM_TO = re.compile(rf"({_TIME})(?:\s*-\s*({_TIME}))?(\+)?")
_NEXT = re.compile(rf"(;)|(?:(?<=[0-9+])|(?<=off)|(?<=closed))\s*,\s*(?=(?:{_D}|ph|sh)\b)")
_HOLIDAY = re.compile(rf"(?:ph|sh)(?:\s*,\s*(?:ph|sh))*(?!\s*,\s*{_D}\b)(?:\s|$)")

# Parts of a day, in minutes.
PARTS = {"morning": (360, 720), "afternoon": (720, 1080), "evening": (1080, 1320), "night": (1320, 1440)}
RANKS = {"open": 0, "unknown": 1, "closed": 2}


def _minute(clock: str) -> int | None:
    h, m = map(int, clock.split(":"))
    return h * 60 + m if h <= 24 and m <= 59 else None


def _spans(what: str) -> list[tuple[int, int, bool]] | None:
    """(from, to, open end) of the hours of a rule; to may pass midnight."""
    out = []
    for first, last, plus in _FROM_TO.findall(what):
        a, b = _minute(first), _minute(last) if last else DAY
        if a is None or b is None:
            return None
        out.append((a, b if b > a or not last else b + DAY, bool(plus)))
    return out


def week(hours: str | None) -> list[list[tuple[int, int, bool]]] | None:
    """The hours of each weekday from Monday, or None if any part isn't understood.

    Of rules for the same day the last one holds; one joined by a comma adds to those before it. Rules for holidays alone are passed over. A day that no rule names is closed.
    """
    text = (hours or "").strip().lower()
    days: list[list[tuple[int, int, bool]]] = [[] for _ in DAYS]
    read, adds, at = 0, False, 0
    for cut in [*_NEXT.finditer(text), None]:
        part = text[at : cut.start() if cut else len(text)].strip()
        if part and not _HOLIDAY.match(part):
            m = _RULE.fullmatch(part)
            spans = None if not m else [] if m["what"] in ("off", "closed") else [(0, DAY, False)] if m["what"] == "24/7" else _spans(m["what"])
            if spans is None:
                return None
            read += 1
            named = set() if m["days"] else set(range(7))
            for a, b in re.findall(rf"({_D})(?:\s*-\s*({_D}))?", m["days"] or ""):
                i = DAYS.index(a)
                named |= {(i + n) % 7 for n in range((DAYS.index(b or a) - i) % 7 + 1)}
            for d in named:
                days[d] = days[d] + spans if adds and spans else spans
        if cut:
            adds, at = cut[1] is None, cut.end()
    return days if read else None


def timeline(hours: str | None) -> tuple[list, list] | None:
    """(open, unsure): ranges in which a place is open, and those in which an open end leaves it unknown. Where both hold it is open; outside both, closed."""
    days = week(hours)
    if days is None:
        return None
    ranges, unsure = [], []
    for d, spans in enumerate(days):
        for a, b, ends_open in spans:
            ranges.append((d * DAY + a, d * DAY + b, None if ends_open else b % DAY))
            if ends_open:
                unsure.append((d * DAY + a, (d + 1) * DAY, None))
                if b >= DAY:
                    unsure.append(((d + 1) * DAY, (d + 1) * DAY + min([x for x, _, _ in days[(d + 1) % 7]], default=DAY), None))
    return ranges, unsure


@pandas_udf(TIMELINE)
def read(hours: pd.Series) -> pd.DataFrame:
    """The timeline of hours; null ranges where they aren't understood."""
    got = [timeline(h) for h in hours]
    rows = lambda k: [None if g is None else [dict(zip(("at", "to", "until"), r, strict=True)) for r in g[k]] for g in got]
    return pd.DataFrame({"open": rows(0), "unsure": rows(1)})


_GUIDE = re.compile(
    r"(?P<daily>\b(?:open\s+)?(?:daily|every\s*day)\b[,:]?\s*)|(?P<join>\s+and\s+)|\b(?P<named>noon|midnight)\b|\b(?P<h>\d{1,2})(?::(?P<m>\d{2}))?\s*(?P<half>[ap])m\b"
    r"|\b(?P<day>mon|tues?|wed(?:nes)?|thu(?:rs?)?|fri|sat(?:ur)?|sun)(?:day)?s?\b|(?P<letter>\b(?-i:[MWF])\b(?=[\s,;-]|$))",
    re.IGNORECASE,
)


def _plain(m: re.Match) -> str:
    if m["daily"]:
        return ""
    if m["join"]:
        return ", "
    if m["named"]:
        return "12:00" if m["named"].lower() == "noon" else "24:00"
    if m["half"]:
        h, minute = int(m["h"]), m["m"] or "00"
        return f"{h % 12 + 12 * (m['half'].lower() == 'p'):02d}:{minute}" if 1 <= h <= 12 and int(minute) < 60 else m[0]
    return {"M": "Mo", "W": "We", "F": "Fr"}[m["letter"]] if m["letter"] else m["day"][:2].capitalize()


def plain(hours: str | None) -> str | None:
    """A guide's hours in the form of maps: "Daily 7AM-3:30PM" is "07:00-15:30", "M-F 07:00-18:00, Sa Su 07:00-15:00" is "Mo-Fr 07:00-18:00, Sa,Su 07:00-15:00". What has no such form stays as it is."""
    if hours is None:
        return None
    return re.sub(rf"\b((?i:{_D}))\s+(?=(?i:{_D})\b)", r"\1,", _GUIDE.sub(_plain, hours)).strip()


@pandas_udf(types.StringType())
def guide(hours: pd.Series) -> pd.Series:
    """plain(), as a column function."""
    return hours.map(plain)


def _holds(minute: Column):
    return lambda r: ((r["at"] <= minute) & (minute < r["to"])) | ((r["at"] <= minute + WEEK) & (minute + WEEK < r["to"]))


def state(line: Column, minute: Column) -> Column:
    """open, closed or unknown at a minute of the week. Hours that aren't understood are unknown, never closed."""
    return F.when(line["open"].isNull(), "unknown").when(F.exists(line["open"], _holds(minute)), "open").when(F.exists(line["unsure"], _holds(minute)), "unknown").otherwise("closed")


def until(line: Column, minute: Column) -> Column:
    """The minute of the day at which a place that is open closes, by the day's own hours before those of the night before; null if it isn't open, or stays open past midnight or to an open end."""
    held = F.filter(line["open"], _holds(minute))
    day = F.floor(minute / DAY)
    own = F.get(F.filter(held, lambda r: F.floor(r["at"] / DAY) == day), F.lit(0))
    night = F.get(held, F.lit(0))["until"]
    return F.when(own.isNull(), night).when(own["to"] < (day + 1) * DAY, own["until"])


def _meets(a: Column, b: Column):
    return lambda r: ((r["at"] < b) & (a < r["to"])) | ((r["at"] < b + WEEK) & (a + WEEK < r["to"]))


def during(line: Column, a: Column, b: Column) -> Column:
    """open if a place is open at any minute of the week from a to b (exclusive), unknown if nobody knows of one, else closed."""
    return F.when(line["open"].isNull(), "unknown").when(F.exists(line["open"], _meets(a, b)), "open").when(F.exists(line["unsure"], _meets(a, b)), "unknown").otherwise("closed")


def rank(state: Column) -> Column:
    """Open first, then unknown, then closed."""
    return F.create_map(*(F.lit(x) for pair in RANKS.items() for x in pair))[state]


def union(ranges: Column) -> Column:
    """Ranges of the week without overlaps, in order: those past its end begin again on Monday, and those that touch are one."""
    cut = F.flatten(F.transform(ranges, lambda r: F.when(r["to"] <= WEEK, F.array(F.struct(r["at"].alias("at"), r["to"].alias("to")))).otherwise(F.array(F.struct(r["at"].alias("at"), F.lit(WEEK).alias("to")), F.struct(F.lit(0).alias("at"), (r["to"] - WEEK).alias("to"))))))
    last = lambda done: F.element_at(done, -1)
    merged = lambda done, r: F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last(done)["at"].alias("at"), F.greatest(last(done)["to"], r["to"]).alias("to"))))
    step = lambda done, r: F.when((F.size(done) > 0) & (F.get(done, F.size(done) - 1)["to"] >= r["at"]), merged(done, r)).otherwise(F.array_append(done, r))
    return F.aggregate(F.array_sort(cut), F.array().cast("array<struct<at: int, to: int>>"), step)


def minutes(ranges: Column, a: Column, b: Column) -> Column:
    """How many minutes of the week from a to b (exclusive, both within the week) the ranges cover."""
    return F.aggregate(union(ranges), F.lit(0), lambda n, r: n + F.greatest(F.lit(0), F.least(r["to"], b) - F.greatest(r["at"], a)))
