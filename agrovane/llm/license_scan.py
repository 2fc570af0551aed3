"""License scan by ordered signature rules.

A text becomes one line of words (A-Z lower-cased; words are runs of letters, digits and non-ASCII characters, joined by one
blank). Rules are regular expressions over that line with a label, a priority and a confidence. A rule runs only if its
keyword is in the line. Detections are intervals of words; one that lies inside a detection of higher priority (or of equal priority and greater
length, or equal in both and of an earlier rule) is suppressed, so "apache license version 2 0" hides the bare mention of "apache license".

Base phrases are places of fixed word sequences; they are counted apart and their labels are never suppressed.

The score is one minus the product of (1 - confidence) over the labels that are left.

Defined cases: NULL or empty text has no words, no labels and score 0; repeated rows and NULL ids are passed on; an empty
table gives an empty result; additional columns are ignored. A row needs memory in proportion to its own text.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base phrases and their labels: fixed values.
BASE = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
BASE_CONFIDENCE = 0.6

_LINE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: bytes
    pattern: re.Pattern
    priority: int
    confidence: float


# Licenses: label, names, versions, words of its identifier. Rules are made from these by the forms below.
_LICENSES = [
    ("apache", ["apache(?: software)? license"], ["1 0", "1 1", "2 0"], "apache"),
    ("mit", ["mit license", "the mit licen[cs]e mit", "expat license"], [], "mit"),
    ("bsd", ["bsd license", "(?:new|modified|simplified|revised) bsd license", "berkeley software distribution"], ["2 clause", "3 clause", "4 clause"], "bsd"),
    ("gpl", ["gnu general public license", "gnu gpl", "gpl"], ["1 0", "2 0", "3 0", "2", "3"], "gpl"),
    ("lgpl", ["gnu (?:lesser|library) general public license", "lesser general public license", "gnu lgpl", "lgpl"], ["2 0", "2 1", "3 0", "3"], "lgpl"),
    ("agpl", ["gnu affero general public license", "affero general public license", "gnu agpl", "agpl"], ["1 0", "3 0", "3"], "agpl"),
    ("mpl", ["mozilla public license", "mpl"], ["1 0", "1 1", "2 0"], "mpl"),
    ("epl", ["eclipse public license", "epl"], ["1 0", "2 0"], "epl"),
    ("cddl", ["common development and distribution license", "cddl"], ["1 0", "1 1"], "cddl"),
    ("cpl", ["common public license"], ["1 0"], "cpl"),
    ("isc", ["isc license", "internet systems consortium license"], [], "isc"),
    ("artistic", ["artistic license", "clarified artistic license"], ["1 0", "2 0"], "artistic"),
    ("boost", ["boost software license"], ["1 0"], "bsl"),
    ("zlib", ["zlib license", "zlib libpng license"], [], "zlib"),
    ("unlicense", ["unlicense"], [], "unlicense"),
    ("wtfpl", ["do what the fuck you want to public license", "wtfpl"], ["2"], "wtfpl"),
    ("eupl", ["european union public licen[cs]e", "eupl"], ["1 0", "1 1", "1 2"], "eupl"),
    ("osl", ["open software license"], ["1 0", "2 0", "2 1", "3 0"], "osl"),
    ("afl", ["academic free license"], ["2 0", "2 1", "3 0"], "afl"),
    ("ofl", ["sil open font license", "open font license"], ["1 0", "1 1"], "ofl"),
    ("python", ["python software foundation license", "psf license"], ["2", "2 0"], "psf"),
    ("php", ["php license"], ["3 0", "3 01"], "php"),
    ("postgresql", ["postgresql licen[cs]e"], [], "postgresql"),
    ("ms-pl", ["microsoft public license"], [], "ms pl"),
    ("ms-rl", ["microsoft reciprocal license"], [], "ms rl"),
    ("gfdl", ["gnu free documentation license", "free documentation license", "gfdl"], ["1 1", "1 2", "1 3"], "gfdl"),
    ("odbl", ["open (?:data commons )?(?:open )?database license", "odbl"], ["1 0"], "odbl"),
    ("odc-by", ["open data commons attribution license"], ["1 0"], "odc by"),
    ("pddl", ["public domain dedication and license"], ["1 0"], "pddl"),
    ("cc0", ["creative commons zero", "cc0", "cc zero"], ["1 0"], "cc0"),
    ("cc-by", ["creative commons attribution(?: licen[cs]e)?"], ["1 0", "2 0", "2 5", "3 0", "4 0"], "cc by"),
    ("cc-by-sa", ["creative commons attribution share ?alike(?: licen[cs]e)?", "cc by sa"], ["1 0", "2 0", "2 5", "3 0", "4 0"], "cc by sa"),
    ("cc-by-nc", ["creative commons attribution non ?commercial(?: licen[cs]e)?", "cc by nc"], ["1 0", "2 0", "2 5", "3 0", "4 0"], "cc by nc"),
    ("cc-by-nd", ["creative commons attribution no ?deriv(?:atives|s)(?: licen[cs]e)?", "cc by nd"], ["1 0", "2 0", "2 5", "3 0", "4 0"], "cc by nd"),
    ("cc-by-nc-sa", ["creative commons attribution non ?commercial share ?alike(?: licen[cs]e)?", "cc by nc sa"], ["1 0", "2 0", "2 5", "3 0", "4 0"], "cc by nc sa"),
    ("cc-by-nc-nd", ["creative commons attribution non ?commercial no ?deriv(?:atives|s)(?: licen[cs]e)?", "cc by nc nd"], ["1 0", "2 0", "2 5", "3 0", "4 0"], "cc by nc nd"),
]

# Sentences: label, keyword, pattern, priority, confidence.
_SENTENCES = [
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy", 70, 0.95),
    ("isc", "permission to use copy modify", "permission to use copy modify and or distribute this software for any purpose", 70, 0.95),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted", 70, 0.95),
    ("gpl", "free software foundation", "under the terms of the gnu general public license as published by the free software foundation", 75, 0.97),
    ("lgpl", "free software foundation", "under the terms of the gnu lesser general public license as published by the free software foundation", 76, 0.97),
    ("agpl", "free software foundation", "under the terms of the gnu affero general public license as published by the free software foundation", 76, 0.97),
    ("zlib", "as is without any express", "this software is provided as is without any express or implied warranty", 40, 0.5),
    ("unlicense", "unencumbered software", "this is free and unencumbered software released into the public domain", 70, 0.95),
    ("public-domain", "public domain", "(?:released into|dedicated to|placed in|in) the public domain", 30, 0.7),
    ("reserved", "rights reserved", "(?:some|no) rights reserved", 20, 0.4),
    ("reserved", "copyright", "copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?", 10, 0.3),
    ("reserved", "unauthorized", "unauthorized (?:copying|use|reproduction|distribution)(?: or \\S+)? .{0,40}?prohibited", 40, 0.7),
    ("reserved", "without permission", "may not be (?:reproduced|copied|distributed)(?: or \\S+)? without (?:prior )?(?:written )?permission", 40, 0.7),
    ("reserved", "confidential", "(?:proprietary and confidential|confidential and proprietary)", 40, 0.7),
]
# Form of a mention: text before the name, priority and confidence added by it.
_FORMS = [
    ("", 0, 0.0),
    ("(?:licensed|released|distributed|available|published) under (?:the |a |an )?(?:terms of )?(?:the )?", 10, 0.15),
    ("spdx license identifier ", 30, 0.2),
]


@cache
def rules() -> tuple[Rule, ...]:
    """All rules in order: for each license, its names with each version and without, in each form; then the sentences."""
    out = []

    def add(label: str, keyword: str, pattern: str, priority: int, confidence: float) -> None:
        out.append(Rule(label, f"{keyword}".encode(), re.compile(f" (?:{pattern})(?= )".encode()), priority, confidence))

    for label, names, versions, tag in _LICENSES:
        for form, more, sure in _FORMS:
            heads = [tag] if form.startswith("spdx") else names
            for head in heads:
                longest = max(re.split(r"\(\?:[^)]*\)\??|\[[^\]]*\]|.\?", head), key=len).strip()
                for version in versions:
                    number = f"{version}(?: only| or later)?" if label != "bsd" else version
                    pattern = f"{form}{number} {head}" if label == "bsd" and not form.startswith("spdx") else f"{form}{head} (?:version |v)?{number}"
                    add(label, longest, pattern, 60 + more + len(label), 0.8 + sure)
                add(label, longest, f"{form}{head}", 50 + more + len(label), 0.7 + sure)
    for label, keyword, pattern, priority, confidence in _SENTENCES:
        add(label, keyword, pattern, priority, confidence)
    return tuple(out)


@cache
def _by_keyword() -> dict[bytes, tuple[int, ...]]:
    gates: dict[bytes, list[int]] = {}
    for number, rule in enumerate(rules()):
        gates.setdefault(rule.keyword, []).append(number)
    return {k: tuple(v) for k, v in gates.items()}


def line_of(text: bytes | None) -> bytes:
    """The words of a text joined by one blank, with a blank at both ends; empty without words."""
    words = (text or b"").translate(_LINE).split()
    return b" " + b" ".join(words) + b" " if words else b""


def phrases(line: bytes) -> list[tuple[int, int, str]]:
    """All places of the base phrases: first byte, byte after, label."""
    out = []
    for phrase, label in BASE.items():
        needle = b" " + phrase.encode() + b" "
        at = line.find(needle)
        while at >= 0:
            out.append((at, at + len(needle) - 1, label))
            at = line.find(needle, at + 1)
    return out


def detections(line: bytes) -> list[tuple[int, int, int]]:
    """Matches of the rules whose keyword is in the line: first byte, byte after, rule."""
    out = []
    for keyword, numbers in _by_keyword().items():
        if keyword in line:
            for number in numbers:
                out += [(m.start(), m.end(), number) for m in rules()[number].pattern.finditer(line)]
    return out


def unsuppressed(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Detections that lie inside no stronger one.

    From the strongest down; kept intervals whose hull can hold the next one are found by a sweep over starts: ordered by start, a detection is
    inside a stronger one exactly if some stronger one with a start not after its own ends not before its end.
    """
    strength = lambda d: (-rules()[d[2]].priority, d[0] - d[1], d[2])
    kept: list[tuple[int, int, int]] = []
    starts: list[int] = []
    ends: list[int] = []  # kept hulls that hold no other one: starts and ends both rise
    for d in sorted(found, key=strength):
        k = bisect_right(starts, d[0]) - 1
        if k >= 0 and ends[k] >= d[1]:
            continue
        kept.append(d)
        # Hulls inside the new one hold nothing that it does not hold.
        low = k + 1 if k < 0 or starts[k] != d[0] else k
        high = low
        while high < len(ends) and ends[high] <= d[1]:
            high += 1
        starts[low:high] = [d[0]]
        ends[low:high] = [d[1]]
    return sorted(kept)


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_detections long, n_suppressed long"


def scan_line(line: bytes) -> tuple:
    """The columns of :data:`SCHEMA` after the id."""
    places = phrases(line)
    found = detections(line)
    kept = unsuppressed(found)
    word = lambda at: line.count(b" ", 0, at)
    base = {label for _, _, label in places}
    sure: dict[str, float] = dict.fromkeys(base, BASE_CONFIDENCE)
    for _, _, number in kept:
        rule = rules()[number]
        sure[rule.label] = max(sure.get(rule.label, 0.0), rule.confidence)
    left = 1.0
    for label in sorted(sure):
        left *= 1.0 - min(sure[label], 0.99)
    return (
        max(line.count(b" ") - 1, 0),
        len(places),
        word(min(p[0] for p in places)) if places else None,
        word(max(p[0] for p in places)) if places else None,
        ",".join(sorted(base)),
        ",".join(sorted(sure)),
        1.0 - left,
        len(kept),
        len(found) - len(kept),
    )


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()] + [pa.int64()] * 2
    names = [part.split(" ")[0] for part in SCHEMA.split(", ")]
    for batch in batches:
        rows = [scan_line(line_of(t)) for t in batch.column("text").cast(pa.large_binary()).to_pylist()]
        columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names)


def op2(docs: DataFrame) -> DataFrame:
    """Words, base phrases, labels and score of every document; no row is moved."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scan, SCHEMA)
