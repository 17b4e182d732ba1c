"""License scan: ordered signature rules over normalized words.

A text is reduced to its words (A-Z lower-cased, joined by single blanks). Rules are hand-
written patterns over such text, each with an identifier, a label, a priority, a confidence
and keywords of which one must occur before the pattern is tried. Detections of all rules
are put in order of priority (then length, then place); one whose span lies within the span
of an earlier one is dropped. Base phrases are found apart and never dropped.

A null or empty text has no words, no labels and score 0. Each row is judged by itself, so
repeated rows give repeated results, and an empty table an empty one. Texts are scanned whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases and the labels they give.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# License families, the names they go by and their versions.
FAMILIES = [
    ("agpl", r"(?:gnu )?affero general public license|agpl", ["1 0", "3 0", "3"]),
    ("lgpl", r"(?:gnu )?(?:lesser|library) general public license|lgpl", ["2 0", "2 1", "3 0", "2", "3"]),
    ("gpl", r"(?:gnu )?general public license|gnu gpl|gpl", ["1 0", "2 0", "3 0", "1", "2", "3"]),
    ("gfdl", r"gnu free documentation license|gfdl", ["1 1", "1 2", "1 3"]),
    ("apache", r"apache (?:software )?license|asl", ["1 0", "1 1", "2 0", "2"]),
    ("mpl", r"mozilla public license|mpl", ["1 0", "1 1", "2 0"]),
    ("epl", r"eclipse public license|epl", ["1 0", "2 0"]),
    ("cddl", r"common development and distribution license|cddl", ["1 0", "1 1"]),
    ("cpl", r"common public license", ["1 0"]),
    ("eupl", r"european union public license|european union public licence|eupl", ["1 0", "1 1", "1 2"]),
    ("artistic", r"artistic license", ["1 0", "2 0"]),
    ("osl", r"open software license", ["1 0", "2 0", "3 0"]),
    ("afl", r"academic free license", ["2 0", "2 1", "3 0"]),
    ("bsl", r"boost software license", ["1 0"]),
    ("bsd", r"bsd license|bsd licence|berkeley software distribution license", ["2 clause", "3 clause", "4 clause"]),
    ("isc", r"isc license|internet systems consortium license", []),
    ("zlib", r"zlib license|zlib libpng license", []),
    ("python", r"python software foundation license|psf license", ["2 0", "2"]),
    ("php", r"php license", ["3 0", "3 01"]),
    ("ruby", r"ruby license", []),
    ("wtfpl", r"wtfpl|do what the fuck you want to public license", ["2"]),
    ("unlicense", r"the unlicense", []),
    ("mit", r"mit license|mit licence|expat license|x11 license", []),
    ("ofl", r"sil open font license|open font license", ["1 0", "1 1"]),
    ("ms-pl", r"microsoft public license", []),
    ("odbl", r"open database license|odbl", ["1 0"]),
    ("pddl", r"public domain dedication and license", ["1 0"]),
    ("openrail", r"open responsible ai license|openrail", []),
    ("llama", r"llama (?:2 |3 )?community license", []),
    ("elastic", r"elastic license", ["1 0", "2 0", "2"]),
    ("sspl", r"server side public license|sspl", ["1"]),
    ("bsl-business", r"business source license|busl", ["1 1"]),
]

# Codes of the Creative Commons family, with the words that stand for each.
CREATIVE = [
    ("cc-by-nc-nd", r"by nc nd|attribution non ?commercial no ?deriv(?:ative|ative work)?s?"),
    ("cc-by-nc-sa", r"by nc sa|attribution non ?commercial share ?alike"),
    ("cc-by-nc", r"by nc|attribution non ?commercial"),
    ("cc-by-nd", r"by nd|attribution no ?deriv(?:ative|ative work)?s?"),
    ("cc-by-sa", r"by sa|attribution share ?alike"),
    ("cc-by", r"by|attribution"),
]

# Sentences that license texts carry even where they do not name themselves.
SENTENCES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "granted"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "distribute"),
    ("bsd", "redistribution and use in source and binary forms with or without modification", "redistribution"),
    ("bsd-3-clause", "neither the name of .{1,80}? nor the names of its contributors", "contributors"),
    ("gpl", "either version [123] of the license or at your option any later version", "version"),
    ("zlib", "this software is provided as is without any express or implied warranty", "warranty"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered"),
    ("public-domain", "(?:released|placed|dedicated) (?:in|into|to) the public domain", "domain"),
    ("cc0", "cc0|cc zero|creative commons zero", "cc0", "cc", "creative"),
    ("proprietary", "all rights reserved", "reserved"),
    ("proprietary", "proprietary and confidential", "proprietary"),
    ("proprietary", "no part of this (?:publication|document|work) may be reproduced", "reproduced"),
]


# Sentences of the headers and grants that families ask to be put into files.
HEADERS = [
    ("apache-2.0", "licensed under the apache license version 2 0 the license", "apache"),
    ("apache-2.0", "you may not use this file except in compliance with the license", "compliance"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "redistribute"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", "redistribute"),
    ("agpl", "under the terms of the gnu affero general public license", "affero"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "document"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla"),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1", "mozilla"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", "eclipse"),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license", "development"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", "organization"),
    ("bsl-1.0", "distributed under the boost software license version 1 0", "boost"),
    ("bsd-2-clause", "redistributions of source code must retain the above copyright notice", "redistributions"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display", "advertising"),
    ("0bsd", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "fee"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee", "documentation"),
    ("ofl", "this font software is licensed under the sil open font license", "font"),
    ("python", "psf is making python 3 available to licensee", "psf"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications", "anyone"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software", "anyone"),
    ("cc0-1.0", "to the extent possible under law .{1,80}? has waived all copyright and related or neighboring rights", "waived"),
    ("eupl", "licensed under the eupl", "eupl"),
    ("busl-1.1", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work", "licensor"),
    ("elastic", "you may not provide the software to third parties as a hosted or managed service", "hosted"),
    ("json", "the software shall be used for good not evil", "evil"),
    ("beerware", "if we meet some day and you think this stuff is worth it you can buy me a beer", "beer"),
    ("wtfpl", "you just do what the fuck you want to", "fuck"),
    ("artistic", "the terms and conditions of this license govern the standard version", "standard"),
]

# Identifiers of the SPDX list.
SPDX = """
    0BSD AFL-1.1 AFL-1.2 AFL-2.0 AFL-2.1 AFL-3.0 AGPL-1.0-only AGPL-1.0-or-later AGPL-3.0-only
    AGPL-3.0-or-later Apache-1.0 Apache-1.1 Apache-2.0 APSL-2.0 Artistic-1.0 Artistic-1.0-Perl
    Artistic-2.0 Beerware BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause
    BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 BUSL-1.1 CC-BY-1.0 CC-BY-2.0 CC-BY-2.5 CC-BY-3.0
    CC-BY-4.0 CC-BY-NC-3.0 CC-BY-NC-4.0 CC-BY-NC-ND-3.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-3.0
    CC-BY-NC-SA-4.0 CC-BY-ND-3.0 CC-BY-ND-4.0 CC-BY-SA-2.0 CC-BY-SA-2.5 CC-BY-SA-3.0 CC-BY-SA-4.0
    CC0-1.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 CPAL-1.0 CPL-1.0 curl ECL-2.0 EFL-2.0 Elastic-2.0
    EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 FTL GFDL-1.1-only GFDL-1.2-only GFDL-1.3-only
    GFDL-1.3-or-later GPL-1.0-only GPL-1.0-or-later GPL-2.0-only GPL-2.0-or-later GPL-3.0-only
    GPL-3.0-or-later HPND ICU IJG IPL-1.0 ISC JSON LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1-only
    LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later Libpng LPPL-1.3c MIT MIT-0 MPL-1.0 MPL-1.1
    MPL-2.0 MPL-2.0-no-copyleft-exception MS-PL MS-RL MulanPSL-2.0 NCSA ODbL-1.0 ODC-By-1.0
    OFL-1.0 OFL-1.1 OpenSSL OSL-1.0 OSL-2.0 OSL-2.1 OSL-3.0 PDDL-1.0 PHP-3.0 PHP-3.01 PostgreSQL
    PSF-2.0 Python-2.0 QPL-1.0 Ruby SSPL-1.0 Unicode-3.0 Unlicense UPL-1.0 Vim W3C WTFPL X11
    Zlib ZPL-2.0 ZPL-2.1
""".split()


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    pattern: str
    keywords: tuple[str, ...]
    priority: int
    confidence: float


def keywords_of(names: str) -> tuple[str, ...]:
    """For each way to write a name, its longest word outside groups that is not common to
    many names, after a blank (a version may follow at once); a text without any of them can't
    match. Names may hold groups of whole words but nothing that changes letters in a word."""
    common = ("general", "license", "licence", "public", "software", "open")
    found = set()
    for name in re.sub(r"\(\?:[^)]*\)\??", "", names).split("|"):
        own = [w for w in name.split() if w not in common]
        word = max(own or ["general public" if "general" in name else name.strip()], key=len)
        found.add(f" {word}")
    return tuple(sorted(found))


def family_rules() -> list[Rule]:
    """Rules of named licenses: grant with version, name with version, identifier tag, grant
    without version, bare name; the more a pattern says, the earlier it comes."""
    rules = []
    for label, names, versions in FAMILIES:
        keywords = keywords_of(names)
        grant = r"(?:released|licensed|distributed|available|published|covered) (?:under|by) (?:the )?(?:terms of )?(?:the )?"
        for version in versions:
            code = f"{label}-{version.replace(' ', '.')}" if "clause" not in version else f"{label}-{version.replace(' ', '-')}"
            numbered = rf"(?:{names})(?: version| v)? ?v?{version}"
            clause = rf"{version} (?:{names})|(?:{names}) {version}"
            said = clause if "clause" in version else numbered
            rules.append(Rule(f"{code}-grant", code, grant + f"(?:{said})", keywords, 10, 0.98))
            rules.append(Rule(f"{code}-name", code, said, keywords, 20, 0.9))
        rules.append(Rule(f"{label}-grant", label, grant + f"(?:{names})", keywords, 30, 0.85))
        rules.append(Rule(f"{label}-name", label, names, keywords, 40, 0.6))
    return rules


def creative_rules() -> list[Rule]:
    rules = []
    for rank, (label, said) in enumerate(CREATIVE):
        for version in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            code = f"{label}-{version.replace(' ', '.')}"
            pattern = rf"(?:cc|creative commons) (?:{said})(?: international| license)? {version}"
            rules.append(Rule(f"{code}-name", code, pattern, ("cc", "creative"), 20 + rank, 0.95))
        rules.append(Rule(f"{label}-name", label, rf"(?:cc|creative commons) (?:{said})", ("cc", "creative"), 40 + rank, 0.75))
    return rules


def spdx_rules() -> list[Rule]:
    """Identifiers after their tag, and those with a number also where they stand alone. The
    endings "only" and "or later" do not make another license. An old identifier is the
    current one without its ending."""
    rules = []
    for identifier in SPDX:
        code = re.sub("-(only|or-later)$", "", identifier.lower())
        words = re.sub("[^a-z0-9]", " ", identifier.lower())
        ways = sorted({words, re.sub("[^a-z0-9]", " ", code)}, key=len)
        for way in ways:
            name = way.replace(" ", "-")
            rules.append(Rule(f"{name}-tag", code, f"spdx license identifier {way}", ("spdx",), 5, 1.0))
            if re.search(r"\d", way) and " " in way:
                rules.append(Rule(f"{name}-id", code, way, (f" {way} ",), 25, 0.8))
    return list({r.name: r for r in rules}.values())


def all_rules() -> list[Rule]:
    rules = [*family_rules(), *creative_rules(), *spdx_rules()]
    for place, (label, pattern, *keywords) in enumerate(HEADERS):
        rules.append(Rule(f"{label}-header-{place}", label, pattern, tuple(keywords), 12, 0.95))
    for label, pattern, *keywords in SENTENCES:
        rules.append(Rule(f"{label}-text", label, pattern, tuple(keywords), 15, 0.9))
    return rules


@lru_cache(maxsize=1)
def compiled() -> tuple[dict[str, list[int]], list[tuple[Rule, re.Pattern]]]:
    """Rules by keyword, and the compiled patterns; patterns match whole words only."""
    rules = [(r, re.compile(rf"(?<= )(?:{r.pattern})(?= )")) for r in all_rules()]
    by_keyword: dict[str, list[int]] = {}
    for place, (rule, _) in enumerate(rules):
        for keyword in rule.keywords:
            by_keyword.setdefault(keyword, []).append(place)
    return by_keyword, rules


# All bytes that are not part of a word become blanks; A-Z become a-z.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def normalized(text: str | None) -> tuple[str, int]:
    """Words joined by single blanks, with one blank at either end; and their number."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split(b" ")
    words = [w for w in words if w]
    return " " + b" ".join(words).decode("utf-8", "surrogatepass") + " ", len(words)


def places(text: str, phrase: str) -> list[int]:
    """Word indexes at which a phrase starts, overlaps included."""
    found, at, word, seen = [], text.find(f" {phrase} "), 0, 0
    while at >= 0:
        word += text.count(" ", seen, at)
        seen = at
        found.append(word)
        at = text.find(f" {phrase} ", at + 1)
    return found


def detections(text: str) -> list[tuple[int, int, Rule]]:
    """Spans and rules that remain of a normalized text, in order of priority."""
    by_keyword, rules = compiled()
    tried = sorted({i for keyword, own in by_keyword.items() if keyword in text for i in own})
    found = [(m.start(), m.end(), rules[i][0]) for i in tried for m in rules[i][1].finditer(text)]
    found.sort(key=lambda d: (d[2].priority, d[0] - d[1], d[0], d[2].name))
    return uncontained(found)


def uncontained(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Drop spans inside one that stands earlier in the list. Kept spans hold the furthest
    end seen from each start, so a look at the starts up to this one is enough."""
    import bisect

    starts: list[int] = []
    ends: list[int] = []  # of the kept spans with the starts above; neither list has a span within another
    kept = []
    for span in found:
        i = bisect.bisect_right(starts, span[0])
        if i and ends[i - 1] >= span[1]:
            continue
        kept.append(span)
        j = i
        while j < len(starts) and ends[j] <= span[1]:
            j += 1
        if i and starts[i - 1] == span[0]:
            i -= 1
        starts[i:j] = [span[0]]
        ends[i:j] = [span[1]]
    return kept


def scan_text(text: str | None) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, rules of a text."""
    norm, n_words = normalized(text)
    at = {phrase: places(norm, phrase) for phrase in BASE}
    every = [p for found in at.values() for p in found]
    base = {BASE[phrase] for phrase, found in at.items() if found}
    kept = detections(norm)
    miss = 1.0
    for _, _, rule in kept:
        miss *= 1.0 - rule.confidence
    if base:
        miss = min(miss, 0.25)
    return (
        n_words, len(every), min(every, default=None), max(every, default=None),
        ",".join(sorted(base)), ",".join(sorted(base | {r.label for _, _, r in kept})),
        1.0 - miss, ",".join(sorted({r.name for _, _, r in kept})),
    )


RESULT = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, "
    "base_labels string, labels string, score double, rules string"
)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per document: words, base places, labels, score and the rules that hold."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.strip().split(" ")[0] for f in RESULT.split(",")][1:]
        for batch in batches:
            rows = pd.DataFrame([scan_text(t) for t in batch["text"]], columns=names)
            for name in ("n_words", "n_base", "first_word", "last_word"):
                rows[name] = rows[name].astype("Int64")
            rows.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None))
            rows["doc_id"] = rows["doc_id"].astype("Int64")
            yield rows

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInPandas(scan, RESULT)
