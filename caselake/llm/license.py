"""License scans: ordered signature rules behind a keyword prefilter, with priority and interval containment.

A text is lower-cased (A-Z only) and read as words; rules are regular expressions over the words joined by
single blanks, so punctuation and line breaks between words never matter. A rule names keywords, all of
which every match holds; it runs only on texts that hold them. Of two detections whose word intervals
contain one another, the one with the lower priority number (and, for equal ones, the longer) suppresses
the other; base rules are never suppressed and suppress only what lies inside them. Rules are names in frames,
names with versions, and single notices.
"""

from __future__ import annotations

import bisect
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import byte_texts, slices

#: Fixed values of the contract: phrase, label. Priority 0; never suppressed.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Licence names as words, label, keywords every match holds (one of those between bars). Each gives a rule for
#: each frame below.
NAMES = (
    ("mit", "mit", "mit"), ("expat", "mit", "expat"), ("x11", "x11", "x11"), ("isc", "isc", "isc"), ("zlib", "zlib", "zlib"),
    ("apache", "apache", "apache"), ("apache 2(?: 0)?", "apache-2", "apache"), ("apache 1 1", "apache-1.1", "apache"),
    ("bsd", "bsd", "bsd"), ("bsd 2 clause(?: simplified)?|2 clause bsd|simplified bsd", "bsd-2-clause", "bsd"), ("bsd 3 clause(?: new| revised| modified)?|3 clause bsd|new bsd|modified bsd", "bsd-3-clause", "bsd"), ("bsd 4 clause(?: original)?|4 clause bsd", "bsd-4-clause", "bsd"), ("0bsd", "0bsd", "0bsd"),
    ("gpl|gnu gpl|gnu general public", "gpl", "gpl|gnu"), ("(?:gnu )?gpl ?v?2(?: 0)?(?: only| or later)?", "gpl-2", "gpl"), ("(?:gnu )?gpl ?v?3(?: 0)?(?: only| or later)?", "gpl-3", "gpl"),
    ("lgpl|gnu lgpl|gnu lesser general public", "lgpl", "lgpl|lesser"), ("lgpl ?v?2 1(?: only| or later)?", "lgpl-2.1", "lgpl"), ("lgpl ?v?3(?: 0)?(?: only| or later)?", "lgpl-3", "lgpl"),
    ("agpl|gnu agpl|gnu affero general public", "agpl", "agpl|affero"), ("agpl ?v?3(?: 0)?(?: only| or later)?", "agpl-3", "agpl"),
    ("mpl|mozilla public", "mpl", "mpl|mozilla"), ("mpl ?v?1 1", "mpl-1.1", "mpl"), ("mpl ?v?2(?: 0)?", "mpl-2", "mpl"),
    ("epl|eclipse public", "epl", "epl|eclipse"), ("epl ?v?1(?: 0)?", "epl-1", "epl"), ("epl ?v?2(?: 0)?", "epl-2", "epl"),
    ("eupl|european union public", "eupl", "eupl|european"), ("cddl|common development and distribution", "cddl", "cddl|development"), ("artistic", "artistic", "artistic"), ("artistic 2(?: 0)?", "artistic-2", "artistic"),
    ("unlicense", "unlicense", "unlicense"), ("wtfpl", "wtfpl", "wtfpl"), ("boost software", "bsl-1", "boost"), ("postgresql", "postgresql", "postgresql"), ("ncsa", "ncsa", "ncsa"), ("vim", "vim", "vim"), ("ruby", "ruby", "ruby"), ("python software foundation|psf", "psf", "psf|python"), ("open font|ofl", "ofl", "ofl|font"), ("open software", "osl", "open software"), ("ms pl|microsoft public", "ms-pl", "ms|microsoft"), ("cecill", "cecill", "cecill"), ("sspl|server side public", "sspl", "sspl|server"), ("business source|busl", "busl", "busl|business"), ("elastic", "elastic", "elastic"), ("odbl|open database", "odbl", "odbl|database"),
)
#: Licences spelt out with their version, which follows the word license: pattern, label, keywords.
VERSIONED = (
    ("gnu general public licen[sc]e(?: gpl)?(?: version| v)? ?v?2(?: 0)?", "gpl-2", "gnu"), ("gnu general public licen[sc]e(?: gpl)?(?: version| v)? ?v?3(?: 0)?", "gpl-3", "gnu"),
    ("gnu (?:lesser|library) general public licen[sc]e(?: lgpl)?(?: version| v)? ?v?2 1", "lgpl-2.1", "gnu"), ("gnu lesser general public licen[sc]e(?: lgpl)?(?: version| v)? ?v?3(?: 0)?", "lgpl-3", "gnu lesser"),
    ("gnu affero general public licen[sc]e(?: agpl)?(?: version| v)? ?v?3(?: 0)?", "agpl-3", "affero"),
    ("mozilla public licen[sc]e(?: version| v)? ?v?1 1", "mpl-1.1", "mozilla"), ("mozilla public licen[sc]e(?: version| v)? ?v?2(?: 0)?", "mpl-2", "mozilla"),
    ("eclipse public licen[sc]e(?: version| v)? ?v?1(?: 0)?", "epl-1", "eclipse"), ("eclipse public licen[sc]e(?: version| v)? ?v?2(?: 0)?", "epl-2", "eclipse"),
    ("apache(?: software)? licen[sc]e(?: version| v)? ?v?2(?: 0)?", "apache-2", "apache"), ("apache(?: software)? licen[sc]e(?: version| v)? ?v?1 1", "apache-1.1", "apache"),
    ("artistic licen[sc]e(?: version| v)? ?v?2(?: 0)?", "artistic-2", "artistic"), ("boost software licen[sc]e(?: version| v)? ?v?1(?: 0)?", "bsl-1", "boost"),
)
#: Words around a name; {} is the name. The first frames are the surest: priority and confidence.
FRAMES = (
    ("spdx(?: license identifier)? (?:{})", "spdx", 10, 1.0),
    ("spdx(?: license identifier)?(?: [a-z0-9]+){{1,12}}? (?:or|and)(?P<m> (?:{}))", "spdx", 11, 1.0),
    ("licen[sc]ed under (?:the )?(?:terms of the )?(?:{})(?: licen[sc]e)?", "licen", 20, 0.95),
    ("(?:released|distributed|available|published|provided) under (?:the )?(?:terms of the )?(?:{})(?: licen[sc]e)?", "under", 30, 0.9),
    ("under (?:the )?(?:terms of the )?(?:{}) licen[sc]e", "under", 40, 0.85),
    ("(?:the )?(?:{}) licen[sc]e", "licen", 50, 0.7),
)
#: Creative Commons: the words after cc, label; each with and without a version, and spelt out.
CC = (("0", "cc0"), ("by", "cc-by"), ("by sa", "cc-by-sa"), ("by nd", "cc-by-nd"), ("by nc", "cc-by-nc"), ("by nc sa", "cc-by-nc-sa"), ("by nc nd", "cc-by-nc-nd"))
CC_SPELT = (("zero", "cc0"), ("attribution", "cc-by"), ("attribution share ?alike", "cc-by-sa"), ("attribution no ?derivatives", "cc-by-nd"), ("attribution non ?commercial", "cc-by-nc"), ("attribution non ?commercial share ?alike", "cc-by-nc-sa"), ("attribution non ?commercial no ?derivatives", "cc-by-nc-nd"))
#: Single notices: pattern, label, keyword, priority, confidence.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", "hereby granted", 15, 0.98),
    ("redistribution and use in source and binary forms with or without modification", "bsd", "redistribution", 15, 0.98),
    ("permission to use copy modify and (?:or )?distribute this software for any purpose", "isc", "distribute this", 15, 0.95),
    ("this program is free software you can redistribute it", "gpl", "free software", 15, 0.95),
    ("you may not use this file except in compliance with the license", "apache", "compliance", 15, 0.9),
    ("this source code form is subject to the terms of the mozilla public license", "mpl", "source code form", 15, 0.98),
    ("this is free and unencumbered software released into the public domain", "unlicense", "unencumbered", 15, 0.98),
    ("(?:in|into|to) the public domain", "public-domain", "public domain", 60, 0.6),
    ("all rights reserved", "all-rights-reserved", "rights reserved", 70, 0.5),
    ("(?:proprietary and confidential|confidential and proprietary)", "proprietary", "proprietary", 60, 0.7),
)
#: A text without any of these holds no match of any rule.
GATES = (b"licen", b"spdx", b"apache", b"cc", b"creative", b"under", b"hereby", b"redistribution", b"distribute", b"free", b"compliance", b"source", b"public", b"rights", b"proprietary")
_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_IN_WORD = np.ones(256, bool)
_IN_WORD[:0x30] = _IN_WORD[0x3A:0x41] = _IN_WORD[0x5B:0x61] = _IN_WORD[0x7B:0x80] = False


class Rule(NamedTuple):
    pattern: re.Pattern
    label: str
    keywords: tuple[tuple[bytes, ...], ...]
    priority: int
    confidence: float


def rules() -> list[Rule]:
    """All rules in order of priority: the base phrases, names x frames, Creative Commons, single notices."""

    def rule(pattern, label, keywords, priority, confidence):
        # the closing blank is only looked at, so neighbouring matches may share it
        return Rule(re.compile(rf" (?:{pattern})(?= )".encode()), label, tuple(tuple(x.encode() for x in w.split("|")) for k in keywords for w in k.split()), priority, confidence)

    out = [rule(p, label, p.split(), 0, 1.0) for p, label in BASE]
    out += [rule(frame.format(name), label, (key, *word.split()), priority, confidence) for frame, word, priority, confidence in FRAMES for name, label, key in NAMES]
    out += [rule(rf"(?:the )?{p}(?: or later)?", label, (key,), 35, 0.9) for p, label, key in VERSIONED]
    out += [rule(rf"(?:licen[sc]ed under )?cc {words}(?: [1-4] [0-9])?", label, ("cc",), 25 - len(words), 0.9) for words, label in CC]
    out += [rule(rf"creative commons {words}(?: [1-4] [0-9])?(?: (?:international|unported|generic))?(?: licen[sc]e)?", label, ("creative",), 25, 0.95) for words, label in CC_SPELT]
    out += [rule(p, label, (key,), priority, confidence) for p, label, key, priority, confidence in NOTICES]
    return sorted(out, key=lambda r: r.priority)


def count_words(text: bytes) -> int:
    w = _IN_WORD[np.frombuffer(text, np.uint8)]
    return int(np.count_nonzero(w[1:] & ~w[:-1])) + int(len(w) and w[0])


def detect(text: bytes, ordered: list[Rule]) -> list[tuple[int, int, Rule]]:
    """(first word, word after the last, rule) of all matches that stay, in order of place."""
    low = text.lower()
    if not any(g in low for g in GATES):
        return []
    open_rules = [r for r in ordered if all(any(w in low for w in k) for k in r.keywords)]
    if not open_rules:
        return []
    joined = b" " + b" ".join(_WORD.findall(low)) + b" "
    blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    found = []
    for r in open_rules:
        # matches of one phrase may overlap, so the search goes on after the first word
        at = r.pattern.search(joined)
        while at:
            # where only a part is the detection, the words before it are there to be looked at
            start, end = at.span("m") if "m" in r.pattern.groupindex else at.span()
            first, last = np.searchsorted(blanks, (start, end))
            found.append((int(first), int(last), r))
            at = r.pattern.search(joined, at.start() + 1 if not r.priority or "m" in r.pattern.groupindex else at.end())
    return suppressed(found)


def suppressed(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Detections that stay, in order of place. A base rule stays and suppresses only what lies inside it.

    Of the others none that is kept contains another, so their ends follow the order of their starts and the two
    neighbours of a new one decide."""
    base = sorted({(a, b) for a, b, r in found if not r.priority})
    reach = np.maximum.accumulate([b for _, b in base]).tolist() if base else []
    kept, starts, ends = [x for x in found if not x[2].priority], [], []
    for first, last, r in sorted((x for x in found if x[2].priority), key=lambda x: (x[2].priority, x[0] - x[1], x[0], x[2].label)):
        k = bisect.bisect_right(base, (first, float("inf")))
        before, after = bisect.bisect_right(starts, first), bisect.bisect_left(starts, first)
        if (k and reach[k - 1] >= last) or (before and ends[before - 1] >= last) or (after < len(ends) and ends[after] <= last):
            continue
        starts.insert(before, first)
        ends.insert(before, last)
        kept.append((first, last, r))
    return sorted(kept, key=lambda x: (x[0], x[1], x[2].priority, x[2].label))


SCHEMA = "n_words long, detections array<struct<first:long, last:long, label:string, priority:int, confidence:double>>"
_DETECTION = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("label", pa.string()), ("priority", pa.int32()), ("confidence", pa.float64())]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, detections): the kept detections of every whole text, in order of place.

    first and last are word numbers from 0, last being the last word of the match. Null and empty texts have
    0 words and no detections; repeated rows give equal rows; other columns are not carried on."""

    def run(batches):
        ordered = rules()
        for b in slices(batches):
            n, all_found = [], []
            for t in byte_texts(b.column(1)):
                n.append(count_words(t))
                all_found.append([{"first": a, "last": z - 1, "label": r.label, "priority": r.priority, "confidence": r.confidence} for a, z, r in detect(t, ordered)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(all_found, _DETECTION)], [id_col, "n_words", "detections"])

    x = docs.select(id_col, text_col)
    return x.mapInArrow(run, f"{id_col} {x.schema[0].dataType.simpleString()}, {SCHEMA}")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row. Null and empty texts
    have no words, empty labels, null places and score 0; repeated rows get equal rows; an empty table gives none."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    base = "filter(detections, d -> d.priority = 0)"

    def joined(a):
        return f"array_join(array_sort(array_distinct(transform({a}, d -> d.label))), ',')"

    return found.selectExpr("doc_id", "n_words", f"cast(size({base}) as long) AS n_base", f"array_min(transform({base}, d -> d.first)) AS first_word", f"array_max(transform({base}, d -> d.first)) AS last_word",
                            f"{joined(base)} AS base_labels", f"{joined('detections')} AS labels", "coalesce(array_max(transform(detections, d -> d.confidence)), 0D) AS score")


SQL: dict[str, str] = {}
QUERIES = {"op4_license_scan": op4_license_scan}
