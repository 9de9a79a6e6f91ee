"""Licence recognition by sentence rules.

A text is cut into sentences, each is normalised and looked up among known licence sentences, and the row of identifiers found is matched against ordered rules: the first rule that fits takes its sentences, then the next. Known sentences that no rule takes are reported as unknown.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from siltstone.llm.common import table

#: Identifier and pattern of a normalised sentence; the first that matches counts.
SENTENCES: list[tuple[str, str]] = [
    ("apache2", r"licen[cs]ed under (?:the )?apache licen[cs]e,? (?:version )?2\.0"),
    ("apache2Warranty", r"unless required by applicable law or agreed to in writing"),
    ("apache2Copy", r"you may obtain a copy of the licen[cs]e at"),
    ("apache2Limits", r"see the licen[cs]e for the specific language governing permissions"),
    ("agpl3Later", r"(?:licen[cs]ed under|under the terms of) (?:the )?(?:gnu affero general public licen[cs]e|agpl).{0,80}3.{0,30}or (?:\(at your option\) )?any later"),
    ("lgplLater", r"(?:licen[cs]ed under|under the terms of) (?:the )?(?:gnu lesser general public licen[cs]e|lgpl).{0,80}(?:3|2\.1).{0,30}or (?:\(at your option\) )?any later"),
    ("agpl3", r"(?:licen[cs]ed under|under the terms of) (?:the )?(?:gnu affero general public licen[cs]e|agpl).{0,80}3"),
    ("lgpl3", r"(?:licen[cs]ed under|under the terms of) (?:the )?(?:gnu lesser general public licen[cs]e|lgpl).{0,80}3"),
    ("lgpl21", r"(?:licen[cs]ed under|under the terms of) (?:the )?(?:gnu lesser general public licen[cs]e|lgpl).{0,80}2\.1"),
    ("gpl3Later", r"(?:licen[cs]ed under|under the terms of) (?:the )?(?:gnu general public licen[cs]e|gpl).{0,80}3.{0,30}or (?:\(at your option\) )?any later"),
    ("gpl3", r"(?:licen[cs]ed under|under the terms of) (?:the )?(?:gnu general public licen[cs]e|gpl).{0,80}3"),
    ("gpl2Later", r"(?:licen[cs]ed under|under the terms of) (?:the )?(?:gnu general public licen[cs]e|gpl).{0,80}2.{0,30}or (?:\(at your option\) )?any later"),
    ("gpl2", r"(?:licen[cs]ed under|under the terms of) (?:the )?(?:gnu general public licen[cs]e|gpl).{0,80}2"),
    ("gplWarranty", r"this program is distributed in the hope that it will be useful"),
    ("mitNamed", r"(?:released|licen[cs]ed|distributed|available) under (?:the )?mit licen[cs]e"),
    ("mitGrant", r"permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("mitNotice", r"the above copyright notice and this permission notice shall be included"),
    ("asIs", r"(?:software|work) is provided \W*as is\W"),
    ("bsdGrant", r"redistribution and use in source and binary forms, with or without modification"),
    ("bsdSource", r"redistributions of source code must retain the above copyright notice"),
    ("bsdBinary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsdNames", r"neither the name of .* may be used to endorse or promote"),
    ("bsdNamed", r"(?:released|licen[cs]ed|distributed) under (?:the )?(?:new |modified |3-clause |2-clause )?bsd licen[cs]e"),
    ("mpl2", r"(?:subject to the terms of|(?:licen[cs]ed|distributed|released|available) under|under the terms of) (?:the )?mozilla public licen[cs]e,? (?:v\.? ?|version )?2\.0"),
    ("ccByNcSa", r"\bcc[ -]by-nc-sa[ -]\d\.\d|licen[cs]ed under (?:a |the )?(?:cc[ -]by-nc-sa|creative commons attribution-noncommercial-sharealike) ?\d\.\d"),
    ("ccByNcNd", r"\bcc[ -]by-nc-nd[ -]\d\.\d|licen[cs]ed under (?:a |the )?(?:cc[ -]by-nc-nd|creative commons attribution-noncommercial-noderivatives) ?\d\.\d"),
    ("ccByNc", r"\bcc[ -]by-nc[ -]\d\.\d|licen[cs]ed under (?:a |the )?(?:cc[ -]by-nc|creative commons attribution-noncommercial) ?\d\.\d"),
    ("ccBySa", r"\bcc[ -]by-sa[ -]\d\.\d|licen[cs]ed under (?:a |the )?(?:cc[ -]by-sa|creative commons attribution-sharealike) ?\d\.\d"),
    ("ccBy", r"\bcc[ -]by[ -]\d\.\d|licen[cs]ed under (?:a |the )?(?:cc[ -]by|creative commons attribution) ?\d\.\d"),
    ("cc0", r"(?:cc0|creative commons zero|dedicated to the public domain)"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("gplRedistribute", r"is free software.{0,40}you can redistribute it and/or modify it under the terms of the gnu (?:lesser |library |affero )?general public licen[cs]e"),
    ("gplCopy", r"you should have received a copy of the gnu (?:lesser |library |affero )?general public licen[cs]e"),
    ("iscGrant", r"permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("iscDisclaimer", r"the author disclaims all warranties with regard to this software"),
    ("zlibWarranty", r"this software is provided 'as-is', without any express or implied warranty"),
    ("zlibGrant", r"permission is granted to anyone to use this software for any purpose, including commercial applications"),
    ("zlibOrigin", r"the origin of this software must not be misrepresented"),
    ("zlibAltered", r"altered source versions must be plainly marked as such"),
    ("zlibNotice", r"this notice may not be removed or altered from any source distribution"),
    ("boostNamed", r"(?:distributed|licen[cs]ed) under the boost software licen[cs]e,? version 1\.0"),
    ("boostGrant", r"permission is hereby granted, free of charge, to any person or organi[sz]ation obtaining a copy of the software and accompanying documentation"),
    ("bsdAdvert", r"all advertising materials mentioning features or use of this software must display"),
    ("bsdWarranty", r"this software is provided by .* \W*as is\W"),
    ("mitNoWarranty", r"in no event shall the authors or copyright holders be liable"),
    ("mplObtain", r"if a copy of the mpl was not distributed with this file, you can obtain one at"),
    ("epl2", r"(?:under the terms of|licen[cs]ed under) the eclipse public licen[cs]e,? (?:v\.? ?|version )?2\.0"),
    ("epl1", r"(?:under the terms of|licen[cs]ed under) the eclipse public licen[cs]e,? (?:v\.? ?|version )?1\.0"),
    ("cddl1", r"subject to the terms of the common development and distribution licen[cs]e"),
    ("artistic2", r"(?:under|under the terms of) the artistic licen[cs]e,? (?:version )?2\.0"),
    ("ofl11", r"licen[cs]ed under the sil open font licen[cs]e,? version 1\.1"),
    ("wtfpl", r"(?:do what the fuck you want to public licen[cs]e|\bwtfpl\b)"),
    ("unlicenseGrant", r"anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("unlicenseDedicate", r"the author or authors of this software dedicate any and all copyright interest"),
    ("ccByNd", r"\bcc[ -]by-nd[ -]\d\.\d|licen[cs]ed under (?:a |the )?(?:cc[ -]by-nd|creative commons attribution-noderiv(?:ative)?s) ?\d\.\d"),
    ("spdx", r"spdx-license-identifier: ?\(?[\w.+-]"),
    ("reserved", r"all rights reserved"),
]
#: Licence and the row of sentence identifiers it needs, in order, other sentences between them allowed; the longer row first.
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("Apache-2.0", ("apache2", "apache2Copy", "apache2Warranty", "apache2Limits")),
    ("GPL-3.0-or-later", ("gpl3Later", "gplWarranty", "gplCopy")), ("GPL-2.0-or-later", ("gpl2Later", "gplWarranty", "gplCopy")), ("GPL-3.0", ("gpl3", "gplWarranty", "gplCopy")), ("GPL-2.0", ("gpl2", "gplWarranty", "gplCopy")),
    ("LGPL-or-later", ("lgplLater", "gplWarranty", "gplCopy")), ("AGPL-3.0-or-later", ("agpl3Later", "gplWarranty", "gplCopy")),
    ("zlib", ("zlibWarranty", "zlibGrant", "zlibOrigin", "zlibAltered", "zlibNotice")), ("Unlicense", ("unlicense", "unlicenseGrant", "unlicenseDedicate")),
    ("BSD-4-Clause", ("bsdGrant", "bsdSource", "bsdBinary", "bsdAdvert", "bsdNames")), ("BSD-3-Clause", ("bsdGrant", "bsdSource", "bsdBinary", "bsdNames", "bsdWarranty")), ("BSD-2-Clause", ("bsdGrant", "bsdSource", "bsdBinary", "bsdWarranty")),
    ("MIT", ("mitGrant", "mitNotice", "asIs", "mitNoWarranty")), ("MIT", ("mitGrant", "mitNotice", "asIs")), ("ISC", ("iscGrant", "iscDisclaimer")), ("BSL-1.0", ("boostGrant",)), ("BSL-1.0", ("boostNamed",)), ("MPL-2.0", ("mpl2", "mplObtain")),
    ("BSD-3-Clause", ("bsdGrant", "bsdSource", "bsdBinary", "bsdNames")),
    ("BSD-2-Clause", ("bsdGrant", "bsdSource", "bsdBinary")),
    ("LGPL-or-later", ("lgplLater",)), ("AGPL-3.0-or-later", ("agpl3Later",)), ("ISC", ("iscGrant",)), ("zlib", ("zlibGrant", "zlibOrigin")), ("EPL-2.0", ("epl2",)), ("EPL-1.0", ("epl1",)), ("CDDL-1.0", ("cddl1",)), ("Artistic-2.0", ("artistic2",)), ("OFL-1.1", ("ofl11",)), ("WTFPL", ("wtfpl",)), ("CC-BY-ND", ("ccByNd",)),
    ("Apache-2.0", ("apache2",)), ("AGPL-3.0", ("agpl3",)), ("LGPL-3.0", ("lgpl3",)), ("LGPL-2.1", ("lgpl21",)),
    ("GPL-3.0-or-later", ("gpl3Later",)), ("GPL-3.0", ("gpl3",)), ("GPL-2.0-or-later", ("gpl2Later",)), ("GPL-2.0", ("gpl2",)),
    ("MIT", ("mitGrant", "asIs")), ("MIT", ("mitNamed",)), ("BSD", ("bsdNamed",)), ("MPL-2.0", ("mpl2",)),
    ("CC-BY-NC-SA", ("ccByNcSa",)), ("CC-BY-NC-ND", ("ccByNcNd",)), ("CC-BY-NC", ("ccByNc",)), ("CC-BY-SA", ("ccBySa",)), ("CC-BY", ("ccBy",)),
    ("CC0-1.0", ("cc0",)), ("Unlicense", ("unlicense",)), ("all-rights-reserved", ("reserved",)),
]
#: Sentences that go with a licence and say nothing on their own.
SILENT = {"apache2Warranty", "apache2Copy", "apache2Limits", "gplWarranty", "gplCopy", "asIs", "bsdWarranty", "mitNoWarranty", "zlibWarranty", "zlibNotice", "iscDisclaimer", "mplObtain"}
_PATTERNS = [(name, re.compile(p)) for name, p in SENTENCES]
_SPDX = re.compile(r"spdx-license-identifier:[ \t]*((?:[()][ \t]*)*[\w.+-]+(?:[ \t()]+(?:and|or|with)[ \t()]+[\w.+-]+)*)", re.I)
_DENIED = re.compile(r"(?:\b(?:not|never|no longer|nor)|n['’]t)\W+(?:\w+\W+){0,3}$")
#: Sentences that a "not" before them takes back: those that name a licence.
_NAMING = {row[0] for _, row in RULES if len(row) == 1} - {"reserved", "bsdGrant", "iscGrant", "boostGrant", "unlicense"}
_HINT = re.compile(r"licen[cs]|lizen[zs]|\bcc[ -]by|redistribution|public domain|cc0|rights reserved|permission|copyright notice|provided|hope that it will|applicable law|name of|creative commons zero|free software|wtfpl|origin of this|altered source|notice may not|warranties|in no event|advertising materials|anyone is free|dedicate any", re.I)
_BREAK = re.compile(r"(?<=[.!?;])(?<!\sv\.)\s+|\n\s*\n")
_MARKS = re.compile(r"(?m)^\s*(?:/\*+|\*+/?|//+|#+|;+|--+|<!--)\s?")
_BLANK = re.compile(r"\s+")


def sentences(text: str) -> list[tuple[int, int, str]]:
    """(start, end, normalised) of the sentences: comment marks at line starts go, white space becomes one space, all in lower case. A line that follows a full stop begins a sentence, one that follows other text goes on with it."""
    out, at = [], 0
    for m in [*_BREAK.finditer(text), None]:
        end = m.start() if m else len(text)
        if end > at:
            raw = text[at:end]
            if _HINT.search(raw):
                out.append((at, end, _BLANK.sub(" ", _MARKS.sub("", raw)).strip().lower()))
        at = m.end() if m else end
    return out


def match(names: list[str]) -> tuple[list[str], list[str]]:
    """(licences, identifiers that no rule took): each rule in order takes its row of identifiers, other ones between them allowed, the first places it can, as often as it can. Time grows with the identifiers, whatever their number."""
    places: dict[str, list[int]] = {}
    for i, name in enumerate(names):
        places.setdefault(name, []).append(i)
    used, found = [False] * len(names), []
    for licence, row in RULES:
        if not all(name in places for name in row):
            continue
        rest = [iter([i for i in places[name] if not used[i]]) for name in row]
        while True:
            at, taken = -1, []
            for places_left in rest:
                at = next((i for i in places_left if i > at), None)
                if at is None:
                    break
                taken.append(at)
            if len(taken) < len(row):
                break
            found.append(licence)
            for i in taken:
                used[i] = True
    return found, [name for i, name in enumerate(names) if not used[i]]


def declared(text: str) -> list[str]:
    """The licences of an SPDX expression, in order: all that AND and OR join, brackets aside; an exception stays with its licence."""
    m = _SPDX.search(text)
    words = re.findall(r"[\w.+-]+", m[1]) if m else []
    out: list[str] = []
    for before, word in zip(["", *words], words, strict=False):
        if before.lower() == "with" and out:
            out[-1] += f" WITH {word}"
        elif word.lower() not in ("and", "or", "with"):
            out.append(word)
    return out


def recognise(text: str | None) -> tuple[list[str], list[str], list[tuple[int, int, str]]]:
    """(licences found, in order of their rules; known sentences left over; (start, end, identifier) of each known sentence). The rules take sentences of the whole text in order."""
    if not text or not _HINT.search(text):
        return [], [], []
    spans = []
    for a, z, s in sentences(text):
        for name, p in _PATTERNS:
            if m := p.search(s):
                if name == "spdx":
                    spans += [(a, z, f"spdx:{x}") for x in declared(text[a:z])]
                elif name not in _NAMING or not _DENIED.search(s[: m.start()]):
                    spans.append((a, z, name))
                break
    found, left = match([name for _, _, name in spans])
    found += [x.removeprefix("spdx:") for x in left if x.startswith("spdx:")]
    return [*dict.fromkeys(found)], [x for x in left if not x.startswith("spdx:") and x not in SILENT], spans


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, licences, unknown, n_sentences, sentences) for every row: licences as a comma-joined string in the rules' order, empty if none; unknown likewise, of known sentences that no rule took; sentences as (start, end, id) in code points. Null and empty texts have none; repeated rows and null ids are kept; empty table: empty result; texts are read whole, however long; other columns, whatever their names, are ignored."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [recognise(t) for t in b["text"]]
            yield pd.DataFrame({
                "doc_id": b["doc_id"], "licences": [",".join(x) for x, _, _ in got], "unknown": [",".join(x) for _, x, _ in got], "n_sentences": [len(x) for _, _, x in got],
                "sentences": [[{"start": a, "end": z, "id": i} for a, z, i in x] for _, _, x in got],
            })

    ids = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {ids}, licences string, unknown string, n_sentences int, sentences array<struct<start:int,end:int,id:string>>")


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).select("doc_id", "licences", "unknown", "n_sentences")
