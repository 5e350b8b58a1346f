"""License scan: ordered signature rules over a text's words, in built-in functions alone.

A rule is a regular expression over the lower-case words of a text, joined by single spaces, with a label, a priority,
a confidence and the words without which it can't match. The rules are names of licenses in several forms (a grant, a
tag, a bare mention) and sentences of license texts; some phrases can be put before them as base rules. A text's words
are looked up once in the set of all needed words; only rules whose needed words are all there are tried.

Overlaps: a detection goes if another one's words contain its words and the other rule's priority is as high or higher;
of two equal stretches the higher priority stays, then the earlier rule. Detections of base rules always stay.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: What a word is made of, after lower-casing A-Z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    label: str
    regex: str  # over words and single spaces; begins and ends with whole words
    needs: tuple[str, ...]  # words that every match contains
    priority: int  # 0: base, then from the highest down
    confidence: float


#: Base phrases and their labels; fixed by the contract.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

_L = "licen[sc]e"
#: Names with a label, a pattern and needed words, one line each: label | pattern | words.
_NAMES = """
mit | mit LIC | mit
mit | expat LIC | expat
mit | x11 LIC | x11
mit-0 | mit no attribution(?: LIC)? | attribution mit
apache-1 | apache(?: software)? LIC(?: version| v)? 1(?: 0)? | apache 1
apache-1-1 | apache(?: software)? LIC(?: version| v)? 1 1 | apache 1
apache-2 | apache(?: software)? LIC(?: version| v)? 2(?: 0)? | apache 2
apache-2 | apache(?: software)? LIC v2(?: 0)? | apache v2
apache-2 | apache 2 0 | apache 2 0
apache | apache(?: software)? LIC | apache
bsd-2 | (?:simplified|freebsd) bsd LIC | bsd
bsd-2 | (?:bsd 2 clause|2 clause bsd|two clause bsd)(?: LIC)? | bsd clause
bsd-3 | (?:new|revised|modified) bsd LIC | bsd
bsd-3 | (?:bsd 3 clause|3 clause bsd|three clause bsd)(?: LIC)? | bsd clause
bsd-4 | (?:original|old) bsd LIC | bsd
bsd-4 | (?:bsd 4 clause|4 clause bsd|four clause bsd)(?: LIC)? | bsd clause
bsd-0 | 0bsd | 0bsd
bsd-0 | zero clause bsd(?: LIC)? | zero bsd
bsd | bsd(?: style)? LIC | bsd
isc | isc LIC | isc
isc | internet systems consortium LIC | consortium
zlib | zlib(?: libpng)? LIC | zlib
boost-1 | boost software LIC(?: version)?(?: 1 0)? | boost software
unlicense | the unlicense(?: org)? | unlicense
unlicense | unlicense org | unlicense org
wtfpl | wtfpl | wtfpl
wtfpl | do what the fuck you want to public LIC | want public
cc0-1 | cc0(?: 1 0)?(?: universal)? | cc0
cc0-1 | creative commons zero(?: v| version)?(?: 1 0)? | creative commons zero
pddl-1 | (?:open data commons )?public domain dedication and LIC | public domain dedication
odbl-1 | (?:odc )?open database LIC | open database
odc-by-1 | open data commons attribution LIC | open data commons
artistic-1 | artistic LIC(?: version)? 1(?: 0)? | artistic 1
artistic-2 | artistic LIC(?: version)? 2(?: 0)? | artistic 2
artistic | artistic LIC | artistic
epl-1 | eclipse public LIC(?: version| v)? 1(?: 0)? | eclipse public 1
epl-2 | eclipse public LIC(?: version| v)? 2(?: 0)? | eclipse public 2
epl | eclipse public LIC | eclipse public
mpl-1 | mozilla public LIC(?: version| v)? 1 0 | mozilla public 1
mpl-1-1 | mozilla public LIC(?: version| v)? 1 1 | mozilla public 1
mpl-2 | mozilla public LIC(?: version| v)? 2(?: 0)? | mozilla public 2
mpl-2 | mozilla public LIC v2(?: 0)? | mozilla public v2
mpl-2 | mpl(?: version| v)? 2(?: 0)? | mpl 2
mpl | mozilla public LIC | mozilla public
cddl-1 | common development and distribution LIC(?: version)? 1(?: 0)? | common development 1
cddl | common development and distribution LIC | common development
cddl-1 | cddl(?: version)? 1 0 | cddl 1
cddl-1-1 | cddl(?: version)? 1 1 | cddl 1
cpl-1 | common public LIC(?: version)?(?: 1 0)? | common public
ipl-1 | ibm public LIC(?: version)?(?: 1 0)? | ibm public
apsl-2 | apple public source LIC(?: version)?(?: 2 0)? | apple public
ms-pl | microsoft public LIC | microsoft public
ms-rl | microsoft reciprocal LIC | microsoft reciprocal
ofl-1-1 | sil open font LIC(?: version)?(?: 1 1)? | open font
ofl-1-1 | ofl 1 1 | ofl 1
python-2 | python software foundation LIC(?: version)?(?: 2)? | python foundation
python-2 | psf LIC(?: version)?(?: 2)? | psf
php-3 | php LIC(?: version)?(?: 3 (?:0|01))? | php
postgresql | postgresql LIC | postgresql
ruby | ruby LIC | ruby
vim | vim LIC | vim
openssl | openssl LIC | openssl
ncsa | (?:university of illinois )?ncsa(?: open source)? LIC | ncsa
json | json LIC | json
w3c | w3c(?: software)?(?: notice and)?(?: document)? LIC | w3c
afl-3 | academic free LIC(?: version| v)?(?: 3 0)? | academic free
osl-3 | open software LIC(?: version| v)?(?: 3 0)? | open software
eupl-1-1 | european union public LIC(?: version| v)? 1 1 | european union 1
eupl-1-2 | european union public LIC(?: version| v)? 1 2 | european union 1 2
eupl-1-1 | eupl(?: version| v)? 1 1 | eupl 1
eupl-1-2 | eupl(?: version| v)? 1 2 | eupl 1 2
eupl | european union public LIC | european union
cecill-2 | cecill(?: free software)?(?: LIC)?(?: version| v)?(?: 2 [01])? | cecill
zpl-2 | zope public LIC(?: version| v)?(?: 2 [01])? | zope
qpl-1 | q public LIC | q public
sleepycat | sleepycat LIC | sleepycat
upl-1 | universal permissive LIC | universal permissive
mulan-2 | mulan(?: permissive software| psl)? (?:LIC )?v2 | mulan v2
blueoak-1 | blue oak model LIC | blue oak
bsl-1-1 | business source LIC(?: version)?(?: 1 1)? | business source
sspl-1 | server side public LIC | server side public
elastic-2 | elastic LIC(?: version)?(?: 2 0)? | elastic
commons-clause | commons clause(?: LIC)?(?: condition)? | commons clause
openrail | (?:creative ml |bigscience )?openrail(?: m| s| d)?(?: LIC)? | openrail
openrail | (?:bigscience )?rail LIC | rail
llama | llama(?: [23])?(?: [123])? community LIC(?: agreement)? | llama community
gemma | gemma terms of use | gemma terms
gfdl | gnu free documentation LIC | gnu documentation
lppl-1 | latex project public LIC(?: version)?(?: 1 3c?)? | latex public
hpnd | historical permission notice and disclaimer | historical disclaimer
naist | naist 2003 LIC | naist
public-domain | (?:dedicated to|released into|placed in|in) the public domain | public domain
proprietary | proprietary(?: software)? LIC | proprietary
evaluation | evaluation LIC(?: agreement)? | evaluation
""".strip().splitlines()

#: Sentences of license texts and notices: label | pattern | words.
_SENTENCES = """
mit | permission is hereby granted free of charge to any person obtaining a copy of this software | permission granted obtaining software
mit | the above copyright notice and this permission notice shall be included in all copies | copyright permission included
isc | permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted | permission distribute software fee
bsd | redistribution and use in source and binary forms with or without modification are permitted | redistribution binary forms permitted
bsd | redistributions of source code must retain the above copyright notice this list of conditions | redistributions retain copyright
bsd-3 | neither the name of(?: [^ ]+){1,12} nor the names of its contributors may be used to endorse or promote products | neither contributors endorse
bsd-4 | all advertising materials mentioning features or use of this software must display the following acknowledge?ment | advertising materials
apache-2 | you may not use this file except in compliance with the LIC | file except compliance
apache-2 | unless required by applicable law or agreed to in writing software distributed under the LIC is distributed on an as is basis | unless applicable writing
gpl | this program is free software you can redistribute it and or modify it under the terms of the gnu general public LIC | program redistribute gnu
lgpl | this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public LIC | library redistribute gnu
agpl-3 | this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public LIC | program affero
gpl | you should have received a copy of the gnu general public LIC | received gnu general
lgpl | you should have received a copy of the gnu lesser general public LIC | received gnu lesser
gfdl | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation LIC | permission documentation
mpl-2 | this source code form is subject to the terms of the mozilla public LIC v 2 0 | source form mozilla
boost-1 | distributed under the boost software LIC version 1 0 | distributed boost
unlicense | this is free and unencumbered software released into the public domain | unencumbered
unlicense | anyone is free to copy modify publish use compile sell or distribute this software | anyone compile sell
zlib | this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages | express authors liable damages
wtfpl | you just do what the fuck you want to | just fuck want
cc0-1 | to the extent possible under law(?: [^ ]+){1,12} has waived all copyright and related or neighboring rights | extent waived neighboring
cc-by | this work is licensed under a creative commons attribution(?: [0-9] [0-9])?(?: international)? LIC | work licensed creative attribution
ofl-1-1 | this font software is licensed under the sil open font LIC | font sil
postgresql | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement | permission documentation fee written
json | the software shall be used for good not evil | software good evil
eupl | licensed under the eupl | licensed eupl
commons-clause | the grant of rights under the LIC will not include and the LIC does not grant to you the right to sell the software | grant rights sell
proprietary | no part of this (?:publication|work|document|book) may be reproduced | part reproduced
proprietary | unauthorized copying of this file via any medium is strictly prohibited | unauthorized medium prohibited
proprietary | all rights reserved no LIC is granted | reserved granted
""".strip().splitlines()

#: GNU licenses: abbreviation, long name, versions.
_GNU = (("gpl", "(?:gnu )?general public LIC", "general public", "1 2 3"), ("lgpl", "(?:gnu )?(?:lesser|library) general public LIC", "general public", "2 2-1 3"), ("agpl", "(?:gnu )?affero general public LIC", "affero public", "1 3"), ("gfdl", "gnu free documentation LIC", "gnu documentation", "1-1 1-2 1-3"))
#: Creative Commons: elements of a license, and the versions.
_CC = ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd")
_CC_WORDS = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?(?: works)?"}
_CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
#: Needed words that are common in any text; each rule needs another one too.
_COMMON = set("0 1 2 3 4 5 by under public use only software just what want general free open work part file any program form source later documentation".split())
#: What can lead to a name: how, the form's needed words, priority, confidence. ``N`` is the name.
_FORMS = (
    (r"(?:licensed|released|distributed|available|published|provided|covered|offered|redistributed|shared)(?: [^ ]+){0,3}? under(?: an?)?(?: the)?(?: terms(?: and conditions)? of)?(?: an?)?(?: the)? (?:N)", ("under",), 1, 0.95),
    (r"(?:spdx LIC identifier|LIC identifier|LIC type|LIC) (?:N)", ("license",), 1, 1.0),
    (r"(?:subject to|governed by|pursuant to|agree to|accept|comply with)(?: the)?(?: terms(?: and conditions)? of)?(?: the)? (?:N)", (), 2, 0.8),
    (r"(?:N)", (), 3, 0.5),
)


def _names() -> list[tuple[str, str, tuple[str, ...]]]:
    """All names: those of the list, and the versions of the GNU and Creative Commons licenses made from their parts."""
    out = []
    for line in _NAMES:
        label, pattern, needs = (x.strip() for x in line.split("|", 1)[0:1] + line.split("|", 1)[1].rsplit("|", 1))
        out.append((label, pattern, tuple(needs.split())))
    for short, long, needs, versions in _GNU:
        later = "(?: only)? or(?: at your option)?(?: any)? later(?: version)?"
        for v in versions.split():
            number = v.replace("-", " ")
            tail = f"(?: version| v)? {number}(?: 0)?"
            for label, end, more in ((f"{short}-{v}", "(?: only)?", ()), (f"{short}-{v}+", later, ("later",))):
                out.append((label, f"{long}(?: {short})?(?: as published by the free software foundation)?(?: either)?{tail}{end}", (*needs.split(), number[0], *more)))
                out.append((label, f"(?:gnu )?{short}{tail}{end}", (short, number[0], *more)))
                out.append((label, f"(?:gnu )?{short}v{number}(?: 0)?{end}", (f"{short}v{number[0]}", *more)))
        out.append((short, long, tuple(needs.split())))
        out.append((short, f"gnu {short}", ("gnu", short)))
    for kind in _CC:
        words = " ".join(_CC_WORDS[x] for x in kind.split("-"))
        for v in (*_CC_VERSIONS, ""):
            label = f"cc-{kind}" + (f"-{v.replace(' 0', '').replace(' ', '-')}" if v else "")
            version = f" {v}" if v else ""
            out.append((label, f"cc {kind.replace('-', ' ')}{version}", ("cc", *kind.split("-"), *version.split())))
            out.append((label, f"creative commons {words}(?: LIC)?{f'(?: version)?{version}' if v else ''}", ("creative", "commons", "attribution", *version.split())))
    return out


def _needs(pattern: str, words: tuple[str, ...]) -> tuple[str, ...]:
    """words, and "license" where the pattern has it outside of groups and alternatives; that stands for both spellings."""
    plain = pattern
    while (less := re.sub(r"\([^()]*\)", "", plain)) != plain:
        plain = less
    return (*words, *["license"] * ("LIC" in plain and "|" not in plain))


def standard_rules() -> list[Rule]:
    """Some hundreds of rules in the order in which they count: sentences, then each name's forms."""
    put = lambda pattern: pattern.replace("LIC", _L)
    out = []
    for line in _SENTENCES:
        label, rest = line.split("|", 1)
        pattern, needs = rest.rsplit("|", 1)
        out.append(Rule(label.strip(), put(pattern.strip()), _needs(pattern, tuple(needs.split())), 1, 1.0))
    names = _names()
    for form, needs, priority, confidence in _FORMS:
        for label, pattern, own in names:
            out.append(Rule(label, put(form.replace("N", pattern)), (*_needs(pattern, own), *needs), priority, confidence))
    return out


def base_rules(phrases=BASE) -> list[Rule]:
    return [Rule(label, re.escape(phrase).replace(r"\ ", " "), tuple(phrase.split()), 0, 0.9) for phrase, label in phrases]


RULES = base_rules() + standard_rules()


def lowered_words(text: Column) -> Column:
    """The words of a text with A-Z as a-z; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def _table(rules: list[Rule]) -> Column:
    """The rules as one constant array; ``find`` stands before each word at which a rule's match begins and captures it."""
    rows = [{"label": r.label, "find": f"(?<= )(?=({r.regex}) )", "needs": sorted(set(r.needs)), "priority": r.priority, "rank": k, "confidence": r.confidence} for k, r in enumerate(rules)]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<label string, find string, needs array<string>, priority int, rank int, confidence double>>")


_SPAN = "struct<start: int, back: int, priority: int, rank: int, label: string, confidence: double>"


def _found(words: Column, rules: list[Rule], gated: bool) -> Column:
    """All detections in the words, sorted so that what contains another comes before it; ``back`` is minus the last word's place."""
    needed = sorted({w for r in rules for w in r.needs} | {"licence"})
    rare = {w for w in needed if w not in _COMMON}
    gated = gated and all(rare & set(r.needs) for r in rules)
    text = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    none = F.array().cast(f"array<{_SPAN}>")

    def places(rule: Column, line: Column) -> Column:
        marked = F.split(F.regexp_replace(line, rule["find"], F.lit("\x01")), " ")
        starts = F.filter(F.transform(marked, lambda w, i: F.when(w.startswith("\x01"), i - 1)), lambda i: i.isNotNull())

        def of(hit: Column, start: Column) -> Column:
            last = start + F.size(F.split(hit, " ")) - 1
            return F.struct(start.alias("start"), (-last).alias("back"), rule["priority"].alias("priority"), rule["rank"].alias("rank"), rule["label"].alias("label"), rule["confidence"].alias("confidence"))

        hits = F.regexp_extract_all(line, rule["find"], F.lit(1))
        return let(hits, lambda h: F.when(F.size(h) == 0, none).otherwise(let(starts, lambda s: F.transform(h, lambda x, k: of(x, F.get(s, k))))))

    def tried(open_: Column) -> Column:
        return let(text, lambda line: F.array_sort(F.flatten(F.transform(open_, lambda r: places(r, line)))))

    if not gated:
        return tried(_table(rules))

    def opened(present: Column) -> Column:
        both = F.when(F.array_contains(present, "licence"), F.array_append(present, "license")).otherwise(present)
        return let(both, lambda p: F.filter(_table(rules), lambda r: F.size(F.array_except(r["needs"], p)) == 0))

    words_here = F.array_intersect(F.array(*map(F.lit, needed)), words)
    return let(words_here, lambda p: F.when(F.arrays_overlap(p, F.array(*map(F.lit, sorted(rare)))), tried(opened(p))).otherwise(none))


def _resolved(spans: Column) -> Column:
    """The detections that no other suppresses.

    What contains a detection begins at most the longest detection's words before it. No more detections than twice the
    fullest stretch of that many words has can stand between, so only so many are looked at, whatever the text's length.
    """

    def of(d: Column, width: Column) -> Column:
        cell = lambda x: F.floor(x["start"] / width)
        zero = F.struct(F.lit(-1).cast("long").alias("cell"), F.lit(0).alias("run"), F.lit(0).alias("most"))

        def step(s: Column, x: Column) -> Column:
            run = F.when(s["cell"] == cell(x), s["run"] + 1).otherwise(1)
            return F.struct(cell(x).alias("cell"), run.alias("run"), F.greatest(s["most"], run).alias("most"))

        def alone(most: Column) -> Column:
            def clear(x: Column, i: Column) -> Column:
                before = F.slice(d, F.greatest(i + 1 - most, F.lit(1)), F.least(i, most))
                return (x["priority"] == 0) | ~F.exists(before, lambda e: (e["back"] <= x["back"]) & (e["priority"] <= x["priority"]))

            return F.filter(d, clear)

        return let(2 * F.aggregate(d, zero, step)["most"], alone)

    longest = lambda d: F.array_max(F.transform(d, lambda x: 1 - x["back"] - x["start"]))
    return let(spans, lambda d: F.when(F.size(d) < 2, d).otherwise(let(longest(d), lambda n: of(d, n))))


def scanned(docs: DataFrame, rules: list[Rule] | None = None, gated: bool = True) -> DataFrame:
    """docs with n_words and detections: array of (start, last, label, priority, confidence), words counted from 0.

    A null or blank text has no words and no detections. Rows are read one by one, whatever repeats; an empty table gives
    no rows. Columns of docs named n_words or detections are replaced. ``gated`` False tries all rules on all texts, with
    the same detections.
    """
    rules = RULES if rules is None else rules

    def of(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n_words"), _resolved(_found(words, rules, gated)).alias("spans"))

    spans = F.transform("_scan.spans", lambda x: F.struct(x["start"].cast("long").alias("start"), (-x["back"]).cast("long").alias("last"), x["label"].alias("label"), x["priority"].alias("priority"), x["confidence"].alias("confidence")))
    names = [c for c in docs.columns if c not in ("n_words", "detections")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), let(lowered_words(F.col("text")), of).alias("_scan"))
    return rows.select(*[F.col(f"_row.`{c}`").alias(c) for c in names], F.col("_scan.n_words").alias("n_words"), spans.alias("detections"))


def digest(rows: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of scanned() rows.

    score is the highest confidence among the detections, 0 without any; labels of no detection are the empty string.
    """
    d = F.col("detections")
    base = F.filter(d, lambda x: x["priority"] == 0)
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda s: s["label"]))), ",")
    return rows.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda x: x["start"])).alias("first_word"), F.array_max(F.transform(base, lambda x: x["start"])).alias("last_word"),
        joined(base).alias("base_labels"), joined(d).alias("labels"),
        F.coalesce(F.array_max(F.transform(d, lambda x: x["confidence"])), F.lit(0.0)).alias("score"),
    )
