"""License mentions by ordered signature rules.

A text becomes its words (letters of ASCII lower-cased; digits; everything beyond ASCII), joined by single
spaces. Each rule is a regular expression over that form with a label, a priority, a weight and keywords
(one, or several with commas), of which every match holds one; it is tried only on texts that contain
one of them. Detections are word intervals. One that lies inside
the interval of another detection is suppressed if the other has the higher priority, or the same
priority and more words, or the same words and an earlier rule. Base phrases are always reported.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_values

#: Phrases whose places are counted, and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

NOTICE, FILE_TAG, NAME, GENERIC = 40, 30, 20, 10  # priorities
WEIGHTS = {NOTICE: 1.0, FILE_TAG: 1.0, NAME: 0.9, GENERIC: 0.5}

# label; keywords of the name; regular expression of the name; tag in files; web address. In words: points,
# hyphens and slashes of the original are spaces here.
FAMILIES = """
0bsd | zero clause | (?:bsd zero clause|zero clause bsd) license | 0bsd | opensource org licenses 0bsd
afl-3 | academic free | academic free license(?: version| v)? 3 0 | afl 3 0 | opensource org licenses afl 3 0
agpl-3 | affero | (?:gnu )?affero general public license(?: as published by the free software foundation)?(?: either)?(?: version| v) ?3(?: 0)? | agpl 3 0(?: only| or later)? | gnu org licenses agpl
agpl | affero | (?:gnu )?affero general public license | agpl(?: v ?\\d)? | gnu org licenses agpl 3 0
apache-1.1 | apache | apache (?:software )?license(?: version| v)? ?1 1 | apache 1 1 | apache org licenses license 1 1
apache-2 | apache | apache (?:software )?license(?: version| v)? ?2(?: 0)? | apache 2 0 | apache org licenses license 2 0
artistic-1 | artistic | artistic license(?: version| v)? 1(?: 0)? | artistic 1 0(?: perl)? | opensource org licenses artistic license 1 0
artistic-2 | artistic | artistic license(?: version| v)? 2(?: 0)? | artistic 2 0 | opensource org licenses artistic license 2 0
beerware | ware license | beer ?ware license | beerware | people freebsd org phk
bsd-2 | bsd | (?:2 clause bsd|bsd 2 clause|simplified bsd|freebsd) license | bsd 2 clause | opensource org licenses bsd 2 clause
bsd-3 | bsd | (?:3 clause bsd|bsd 3 clause|new bsd|modified bsd|revised bsd) license | bsd 3 clause | opensource org licenses bsd 3 clause
bsd-4 | bsd | (?:4 clause bsd|bsd 4 clause|original bsd) license | bsd 4 clause | spdx org licenses bsd 4 clause
bsd | bsd | bsd (?:style )?license | bsd | opensource org licenses bsd license
bsl-1 | boost | boost software license(?: version| v)? ?1(?: 0)? | bsl 1 0 | boost org license 1 0
busl-1.1 | business source | business source license(?: version| v)? ?1 1 | busl 1 1 | mariadb com bsl11
cc-by-1 | attribution | creative commons attribution(?: license)? 1 0 | cc by 1 0 | creativecommons org licenses by 1 0
cc-by-2 | attribution | creative commons attribution(?: license)? 2 0 | cc by 2 0 | creativecommons org licenses by 2 0
cc-by-2.5 | attribution | creative commons attribution(?: license)? 2 5 | cc by 2 5 | creativecommons org licenses by 2 5
cc-by-3 | attribution | creative commons attribution(?: license)? 3 0 | cc by 3 0 | creativecommons org licenses by 3 0
cc-by-4 | attribution | creative commons attribution(?: license)? 4 0 | cc by 4 0 | creativecommons org licenses by 4 0
cc-by-sa-2 | sharealike | creative commons attribution sharealike(?: license)? 2 [05] | cc by sa 2 [05] | creativecommons org licenses by sa 2 [05]
cc-by-sa-3 | sharealike | creative commons attribution sharealike(?: license)? 3 0 | cc by sa 3 0 | creativecommons org licenses by sa 3 0
cc-by-sa-4 | sharealike | creative commons attribution sharealike(?: license)? 4 0 | cc by sa 4 0 | creativecommons org licenses by sa 4 0
cc-by-sa | attribution share | (?:creative commons )?attribution share ?alike | cc by sa | creativecommons org licenses by sa
cc-by-nc-4 | noncommercial | creative commons attribution noncommercial(?: license)? 4 0 | cc by nc 4 0 | creativecommons org licenses by nc 4 0
cc-by-nc | attribution non | (?:creative commons )?attribution non ?commercial | cc by nc | creativecommons org licenses by nc
cc-by-nc-sa-4 | noncommercial | creative commons attribution noncommercial sharealike(?: license)? 4 0 | cc by nc sa 4 0 | creativecommons org licenses by nc sa 4 0
cc-by-nc-sa | attribution non | (?:creative commons )?attribution non ?commercial share ?alike | cc by nc sa | creativecommons org licenses by nc sa
cc-by-nc-nd-4 | noncommercial | creative commons attribution noncommercial noderiv(?:ative)?s(?: license)? 4 0 | cc by nc nd 4 0 | creativecommons org licenses by nc nd 4 0
cc-by-nc-nd | attribution non | (?:creative commons )?attribution non ?commercial no ?deriv(?:ative)?s | cc by nc nd | creativecommons org licenses by nc nd
cc-by-nd-4 | noderiv | creative commons attribution noderiv(?:ative)?s(?: license)? 4 0 | cc by nd 4 0 | creativecommons org licenses by nd 4 0
cc-by-nd | deriv | (?:creative commons )?attribution no ?deriv(?:ative)?s | cc by nd | creativecommons org licenses by nd
cc0 | cc0 | cc0(?: 1 0)?(?: universal)?(?: public domain dedication)? | cc0 1 0 | creativecommons org publicdomain zero 1 0
cddl-1 | common development | common development and distribution license(?: version| v)? ?1 [01] | cddl 1 [01] | opensource org licenses cddl1
cecill-2.1 | cecill | cecill(?: free software)? license(?: agreement)?(?: version| v)? ?2 1 | cecill 2 1 | cecill info licences licence cecill v2 1
cecill | cecill | cecill(?: [bc])?(?: free software)? licen[cs]e | cecill [bc] | cecill info licences
cpal-1 | attribution license | common public attribution license(?: version| v)? ?1(?: 0)? | cpal 1 0 | opensource org licenses cpal 1 0
cpl-1 | common public | common public license(?: version| v)? ?1(?: 0)? | cpl 1 0 | opensource org licenses cpl1
ecl-2 | educational | educational community license(?: version| v)? ?2(?: 0)? | ecl 2 0 | opensource org licenses ecl 2 0
elastic-2 | elastic | elastic license(?: version| v)? ?2(?: 0)? | elastic 2 0 | elastic co licensing elastic license
epl-1 | eclipse | eclipse public license(?: version| v)? ?1(?: 0)? | epl 1 0 | eclipse org legal epl v10
epl-2 | eclipse | eclipse public license(?: version| v)? ?2(?: 0)? | epl 2 0 | eclipse org legal epl 2 0
epl | eclipse | eclipse public license | epl | eclipse org legal epl
eupl-1.2 | european union | european union public licen[cs]e(?: version| v)? ?1 [12] | eupl 1 [12] | joinup ec europa eu software page eupl
fdl-1.3 | documentation | gnu free documentation license(?: version| v)? ?1 [23] | gfdl 1 [23](?: only| or later)? | gnu org licenses fdl 1 [23]
fdl | documentation | gnu free documentation license | gfdl | gnu org copyleft fdl
gpl-1 | general public | gnu general public license(?: as published by the free software foundation)?(?: either)?(?: version| v) ?1(?: 0)? | gpl 1 0(?: only| or later)? | gnu org licenses old licenses gpl 1 0
gpl-2 | general public | gnu general public license(?: as published by the free software foundation)?(?: either)?(?: version| v) ?2(?: 0)? | gpl 2 0(?: only| or later)? | gnu org licenses old licenses gpl 2 0
gpl-3 | general public | gnu general public license(?: as published by the free software foundation)?(?: either)?(?: version| v) ?3(?: 0)? | gpl 3 0(?: only| or later)? | gnu org licenses gpl 3 0
hpnd | historical permission | historical permission notice and disclaimer | hpnd | opensource org licenses hpnd
icu | icu license | icu license | icu | unicode org copyright
ipl-1 | ibm public | ibm public license(?: version| v)? ?1(?: 0)? | ipl 1 0 | opensource org licenses ipl 1 0
isc | isc license | isc license | isc | opensource org licenses isc
lgpl-2 | library general | gnu library general public license(?: version| v)? ?2(?: 0)? | lgpl 2 0(?: only| or later)? | gnu org licenses old licenses lgpl 2 0
lgpl-2.1 | lesser general | gnu lesser general public license(?: as published by the free software foundation)?(?: either)?(?: version| v) ?2 1 | lgpl 2 1(?: only| or later)? | gnu org licenses old licenses lgpl 2 1
lgpl-3 | lesser general | gnu lesser general public license(?: as published by the free software foundation)?(?: either)?(?: version| v) ?3(?: 0)? | lgpl 3 0(?: only| or later)? | gnu org licenses lgpl 3 0
lgpl | general public | gnu (?:lesser|library) general public license | lgpl | gnu org licenses lgpl
lppl-1.3 | latex project | latex project public license(?: version| v)? ?1 3[abc]? | lppl 1 3[abc]? | latex project org lppl
mit-0 | mit no | mit no attribution(?: license)? | mit 0 | github com aws mit 0
mit-x11 | x11 | (?:mit x11|x11 mit|x11) license | x11 | xfree86 org 3 3 6 copyright2
mit-expat | expat | expat(?: mit)? license | mit | opensource org licenses mit
mpl-1.1 | mozilla | mozilla public license(?: version| v)? ?1 [01] | mpl 1 [01] | mozilla org mpl 1 [01]
mpl-2 | mozilla | mozilla public license(?: version| v)? ?2(?: 0)? | mpl 2 0 | mozilla org (?:en us )?mpl 2 0
mpl | mozilla | mozilla public license | mpl | mozilla org mpl
ms-pl | microsoft public | microsoft public license | ms pl | opensource org licenses ms pl
ms-rl | microsoft reciprocal | microsoft reciprocal license | ms rl | opensource org licenses ms rl
mulan-2 | mulan | mulan permissive software license(?: version| v)? ?2 | mulanpsl 2 0 | license coscl org cn mulanpsl2
ncsa | illinois | university of illinois(?: ncsa)? open source license | ncsa | opensource org licenses ncsa
odbl-1 | open database | open (?:data commons open )?database license(?: version| v)?(?: ?1 0)? | odbl 1 0 | opendatacommons org licenses odbl
odc-by-1 | open data | open data commons attribution license(?: version| v)?(?: ?1 0)? | odc by 1 0 | opendatacommons org licenses by
ofl-1.1 | open font | sil open font license(?: version| v)?(?: ?1 1)? | ofl 1 1 | scripts sil org ofl
osl-3 | open software | open software license(?: version| v)? ?3(?: 0)? | osl 3 0 | opensource org licenses osl 3 0
pddl-1 | public domain | (?:open data commons )?public domain dedication and licen[cs]e | pddl 1 0 | opendatacommons org licenses pddl
php-3 | php license | php license(?: version| v)? ?3 0?[01]? | php 3 0?1? | php net license
polyform | polyform | polyform (?:noncommercial|small business|shield|strict) license | polyform [a-z]+ | polyformproject org licenses
postgresql | postgresql | postgresql licen[cs]e | postgresql | postgresql org about licence
psf-2 | python software | python software foundation license(?: version| v)?(?: ?2)? | psf 2 0 | docs python org license
qpl-1 | q public | q public license(?: version| v)?(?: ?1 0)? | qpl 1 0 | opensource org licenses qtpl
rail | rail | (?:bigscience |creativeml )?open ?rail(?: [ms])? license | openrail | huggingface co spaces license
ruby | ruby license | ruby license | ruby | ruby lang org en about license
sspl-1 | server side | server side public license(?: version| v)?(?: ?1)? | sspl 1 0 | mongodb com licensing server side public license
unicode | unicode license | unicode license(?: agreement)? | unicode (?:dfs 201[56]|3 0) | unicode org license
unlicense | unlicense | (?:the )?unlicense | unlicense | unlicense org
upl-1 | universal permissive | universal permissive license(?: version| v)?(?: ?1 0)? | upl 1 0 | oss oracle com licenses upl
w3c | w3c | w3c software(?: notice)?(?: and)?(?: document)? license | w3c | w3 org consortium legal
wtfpl | wtfpl, what the fuck | (?:do what the fuck you want to public license|wtfpl) | wtfpl | wtfpl net
zlib | zlib | zlib(?: libpng)? license | zlib | zlib net zlib license
zpl-2 | zope | zope public license(?: version| v)? ?2 [01] | zpl 2 [01] | zope org resources license
""".strip().splitlines()

# label; priority; keywords; expression: sentences of license texts and notices
SENTENCES = """
mit | 40 | free of charge | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | 40 | sublicense | without restriction including without limitation the rights to use copy modify merge publish distribute sublicense
mit | 20 | mit licen | (?:under|by|of|the) mit licen[cs]e
mit | 20 | licensed under | licensed under (?:the )?mit
isc | 40 | with or without fee | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee
bsd | 40 | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd-3 | 40 | endorse | neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote products
bsd-4 | 40 | acknowledg | all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment
apache-2 | 40 | apache | licensed under the apache license version 2 0 the license
apache-2 | 40 | compliance | you may not use this file except in compliance with the license
apache | 20 | apache | (?:under|by|of|the) apache (?:software )?licen[cs]e
gpl | 40 | redistribute | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl-2 | 20 | gpl | (?:gnu )?gpl(?: ?v| version)? ?2(?: 0)?
gpl-3 | 20 | gpl | (?:gnu )?gpl(?: ?v| version)? ?3(?: 0)?
gpl | 20 | gpl | (?:gnu )?gpl
lgpl-2.1 | 20 | lgpl | (?:gnu )?lgpl(?: ?v| version)? ?2 1
lgpl-3 | 20 | lgpl | (?:gnu )?lgpl(?: ?v| version)? ?3(?: 0)?
lgpl | 20 | lgpl | (?:gnu )?lgpl
agpl-3 | 20 | agpl | (?:gnu )?agpl(?: ?v| version)? ?3(?: 0)?
mpl-2 | 40 | mozilla | this source code form is subject to the terms of the mozilla public license
epl-2 | 40 | eclipse | this program and the accompanying materials are made available under the terms of the eclipse public license
unlicense | 40 | public domain | this is free and unencumbered software released into the public domain
cc0 | 40 | neighboring rights | (?:waived|waives) all copyright and related or neighboring rights
zlib | 40 | warranty | this software is provided as is without any express or implied warranty in no event will the authors be held liable
bsl-1 | 40 | boost | distributed under the boost software license
ofl-1.1 | 40 | font | this font software is licensed under the sil open font license
wtfpl | 40 | verbatim | everyone is permitted to copy and distribute verbatim or modified copies of this license document
public-domain | 10 | public domain | (?:released|placed|dedicated)(?: in)?(?: in)?to the public domain
public-domain | 10 | public domain | (?:is|are) in the public domain
proprietary | 10 | all rights reserved | (?:copyright )?(?:c )?(?:\\d{4} )?(?:[^ ]+ ){0,6}?all rights reserved
proprietary | 10 | proprietary | proprietary and confidential
creative-commons | 10 | creative commons | (?:under a |under the )?creative commons (?:licen[cs]e|licensed)
unknown-license | 10 | licen | licensed under (?:the )?(?:terms of )?(?:the )?(?:[^ ]+ ){0,5}?licen[cs]e
unknown-license | 10 | licen | (?:released|distributed|available|published|provided) under (?:the )?(?:[^ ]+ ){0,5}?licen[cs]e
unknown-license | 10 | licen | subject to the (?:terms of the )?(?:[^ ]+ ){0,5}?licen[cs]e
unknown-license | 10 | licen | see (?:the )?license (?:file|txt|md) for (?:more )?(?:details|information|terms)
unknown-license | 10 | licence | (?:released|distributed|available|published|licensed) under (?:the )?(?:[^ ]+ ){0,5}?licence
""".strip().splitlines()


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    keyword: str
    pattern: re.Pattern[bytes]

    @property
    def keywords(self) -> list[str]:
        return self.keyword.split(", ")


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules in order: the forms of each family (tag in a file, first or later in its expression,
    address, name, name with a verb), then the sentences. Names are spelled with s or c. Of a rule with a
    group ``own`` that group is what it detects."""
    found = []

    def add(label: str, priority: int, keyword: str, expression: str) -> None:
        expression = re.sub(r"license(?!d| identifier|s)", "licen[cs]e", expression)
        keyword = re.sub(r"license(?=,|$)", "licen", keyword)
        pattern = re.compile(rf"(?<![^ ])(?:{expression})(?![^ ])".encode())
        found.append(Rule(label, priority, keyword, pattern))

    for line in FAMILIES:
        label, keyword, name, tag, address = (part.strip().replace("\\\\", "\\") for part in line.split(" | "))
        add(label, FILE_TAG, "spdx", rf"spdx license identifier {tag}")
        add(label, FILE_TAG, "spdx",
            rf"spdx license identifier (?:(?:[^ ]+ ){{1,6}}?(?:or|and|with) ){{1,4}}?(?P<own>{tag})")
        add(label, FILE_TAG, address.split(" ")[0], rf"(?:https? )?(?:www )?{address}")
        add(label, NAME, keyword, rf"(?:the )?{name}")
        add(label, NOTICE, keyword,
            rf"(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?{name}")
        add(label, NAME, "licen", rf"licen[cs]e (?:is )?{tag}")
    for line in SENTENCES:
        label, priority, keyword, expression = (part.strip().replace("\\\\", "\\") for part in line.split(" | "))
        add(label, int(priority), keyword, expression)
    return tuple(found)


@lru_cache(maxsize=1)
def _keywords() -> ahocorasick.Automaton:
    """All keywords in one automaton: a text is read once, whatever the number of rules."""
    automaton = ahocorasick.Automaton()
    for rule in rules():
        for word in rule.keywords:
            automaton.add_word(word, word)
    automaton.make_automaton()
    return automaton


@dataclass(frozen=True)
class Detection:
    label: str
    priority: int
    rule: int
    start: int
    end: int  # words, the last one excluded


_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split(b" ")


def scan(joined: bytes) -> tuple[list[Detection], list[tuple[int, str]]]:
    """Detections that remain, and the ``(first word, label)`` of every base phrase, of words joined by
    single spaces."""
    base = []
    for phrase, label in BASE.items():
        wanted = phrase.encode()
        at = joined.find(wanted)
        while at >= 0:
            after = at + len(wanted)
            if (at == 0 or joined[at - 1] == 32) and (after == len(joined) or joined[after] == 32):
                base.append((at, label))
            at = joined.find(wanted, at + 1)
    spans = []
    present = {word for _, word in _keywords().iter(joined.decode("latin-1"))}
    for number, rule in enumerate(rules()) if present else ():
        if not present.isdisjoint(rule.keywords):
            own = "own" if rule.pattern.groupindex else 0
            spans += [(number, *m.span(own)) for m in rule.pattern.finditer(joined)]
    if not base and not spans:
        return [], []
    places = sorted({p for p, _ in base} | {a for _, a, _ in spans})
    before = dict(zip(places, _spaces_before(joined, places)))
    found = [
        Detection(rules()[n].label, rules()[n].priority, n, before[a], before[a] + joined.count(b" ", a, b) + 1)
        for n, a, b in spans
    ]
    return suppress(found), sorted((before[p], label) for p, label in base)


def _spaces_before(joined: bytes, places: list[int]) -> list[int]:
    out, at, n = [], 0, 0
    for place in places:
        n += joined.count(b" ", at, place)
        out.append(n)
        at = place
    return out


def suppress(found: list[Detection]) -> list[Detection]:
    """The detections that lie in no stronger one, in text order.

    Strongest first: priority, then words, then the order of the rules. Kept intervals are maximal among
    themselves, so sorted by start they are sorted by end too, and the last one that starts at or before
    a candidate tells whether it is contained.
    """
    starts: list[int] = []
    ends: list[int] = []
    kept = []
    for d in sorted(found, key=lambda d: (-d.priority, d.start - d.end, d.rule, d.start)):
        i = bisect_right(starts, d.start)
        if i and ends[i - 1] >= d.end:
            continue
        kept.append(d)
        # a weaker one may contain stronger ones: those stay kept, their intervals are covered now
        j = i
        while j < len(starts) and ends[j] <= d.end:
            j += 1
        while i and starts[i - 1] >= d.start:
            i -= 1
        starts[i:j], ends[i:j] = [d.start], [d.end]
    return sorted(kept, key=lambda d: (d.start, d.end, d.rule))


DETECTION = pa.struct([
    ("label", pa.string()), ("priority", pa.int32()), ("rule", pa.int32()),
    ("start", pa.int64()), ("end", pa.int64()),
])


def find_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_words, base, detections, score)`` per document.

    ``base`` holds ``(start, label)`` of every base phrase, ``detections`` the remaining intervals of words
    with label, priority and number of the rule. ``score`` is the largest weight of a detection's priority,
    0.9 at least with a base phrase, 0 without either. A null text is empty. Each row, repeated or with a
    null key, has a row of its own; whole texts are scanned.
    """
    chosen = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("__text"))
    kind = chosen.schema[key].dataType.simpleString()
    place = pa.struct([("start", pa.int64()), ("label", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            many, bases, all_found, scores = [], [], [], []
            for value in byte_values(batch.column(1)):
                own = [w for w in words(value) if w]
                found, base = scan(b" ".join(own))
                many.append(len(own))
                bases.append([{"start": s, "label": label} for s, label in base])
                all_found.append([
                    {"label": d.label, "priority": d.priority, "rule": d.rule, "start": d.start, "end": d.end}
                    for d in found
                ])
                weights = [WEIGHTS[d.priority] for d in found] + [WEIGHTS[NAME]] * bool(base)
                scores.append(max(weights, default=0.0))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(many, pa.int64()), pa.array(bases, pa.list_(place)),
                pa.array(all_found, pa.list_(DETECTION)), pa.array(scores, pa.float64()),
            ], [key, "n_words", "base", "detections", "score"])

    return chosen.mapInArrow(
        run, f"`{key}` {kind}, n_words long, base array<struct<start:bigint,label:string>>, "
        "detections array<struct<label:string,priority:int,rule:int,start:bigint,end:bigint>>, score double"
    )
