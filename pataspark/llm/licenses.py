"""License statements by ordered signature rules.

The text is reduced to lower-case words once. Rules are regular expressions over that word string, made
from a table of licenses and a table of statement forms plus distinctive sentences. A rule is only tried when its keyword occurs in the text.
Overlapping detections are resolved by priority: a detection inside the interval of one that
ranks higher is suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pataspark.llm.common import word_bytes

# The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Label: names of the license, as words. Longer names come first, as they rank higher.
NAMES = {
    "agpl-3.0": ("gnu affero general public license version 3", "gnu affero general public license", "gnu agpl v3", "agpl 3 0", "agpl v3", "agplv3"),
    "lgpl-3.0": ("gnu lesser general public license version 3", "lgpl 3 0", "lgpl v3", "lgplv3"),
    "lgpl-2.1": ("gnu lesser general public license version 2 1", "gnu library general public license", "lgpl 2 1", "lgpl v2 1", "lgplv2"),
    "gpl-3.0": ("gnu general public license version 3", "gnu general public license v3", "gnu gpl v3", "gpl 3 0", "gpl v3", "gplv3"),
    "gpl-2.0": ("gnu general public license version 2", "gnu general public license v2", "gnu gpl v2", "gpl 2 0", "gpl v2", "gplv2"),
    "apache-2.0": ("apache license version 2 0", "apache license 2 0", "apache 2 0", "apache software license 2 0", "asl 2 0"),
    "mit": ("massachusetts institute of technology license", "the mit license", "mit license", "expat license", "mit x11 license"),
    "bsd-4-clause": ("original bsd license", "bsd 4 clause license", "bsd 4 clause"),
    "bsd-3-clause": ("modified bsd license", "new bsd license", "revised bsd license", "bsd 3 clause license", "bsd 3 clause", "3 clause bsd"),
    "bsd-2-clause": ("simplified bsd license", "freebsd license", "bsd 2 clause license", "bsd 2 clause", "2 clause bsd"),
    "0bsd": ("zero clause bsd", "bsd zero clause license", "0bsd"),
    "mpl-2.0": ("mozilla public license version 2 0", "mozilla public license v 2 0", "mozilla public license 2 0", "mpl 2 0"),
    "mpl-1.1": ("mozilla public license version 1 1", "mozilla public license 1 1", "mpl 1 1"),
    "epl-2.0": ("eclipse public license version 2 0", "eclipse public license v2 0", "eclipse public license 2 0", "epl 2 0"),
    "epl-1.0": ("eclipse public license version 1 0", "eclipse public license v1 0", "eclipse public license 1 0", "epl 1 0"),
    "cddl-1.0": ("common development and distribution license", "cddl 1 0"),
    "cpl-1.0": ("common public license version 1 0", "common public license"),
    "eupl-1.2": ("european union public licence", "eupl 1 2"),
    "isc": ("internet systems consortium license", "isc license"),
    "zlib": ("zlib libpng license", "zlib license"),
    "boost-1.0": ("boost software license version 1 0", "boost software license", "bsl 1 0"),
    "unlicense": ("the unlicense", "unlicense"),
    "wtfpl": ("do what the fuck you want to public license", "wtfpl"),
    "artistic-2.0": ("artistic license 2 0", "the artistic license", "artistic license"),
    "psf-2.0": ("python software foundation license", "psf license"),
    "ms-pl": ("microsoft public license", "ms pl"),
    "postgresql": ("postgresql license", "postgresql licence"),
    "openssl": ("openssl license", "ssleay license"),
    "ofl-1.1": ("sil open font license", "ofl 1 1"),
    "odbl-1.0": ("open database license", "odbl 1 0", "odbl"),
    "cc0-1.0": ("creative commons zero", "cc0 1 0", "cc0"),
    "cc-by-nc-nd-4.0": ("creative commons attribution noncommercial noderivatives", "creative commons attribution non commercial no derivatives", "cc by nc nd"),
    "cc-by-nc-sa-4.0": ("creative commons attribution noncommercial sharealike", "creative commons attribution non commercial share alike", "cc by nc sa"),
    "cc-by-nc-4.0": ("creative commons attribution noncommercial", "creative commons attribution non commercial", "cc by nc"),
    "cc-by-nd-4.0": ("creative commons attribution noderivatives", "creative commons attribution no derivatives", "cc by nd"),
    "cc-by-sa-4.0": ("creative commons attribution sharealike", "creative commons attribution share alike", "cc by sa"),
    "cc-by": ("creative commons attribution", "cc by"),
    "apache": ("apache software license", "apache license", "apache public license"),
    "gpl": ("gnu general public license", "gnu gpl", "gnu public license"),
    "lgpl": ("gnu lesser general public license", "gnu lgpl"),
    "mpl": ("mozilla public license",),
    "epl": ("eclipse public license",),
    "bsd": ("bsd license", "bsd style license", "berkeley software distribution license"),
}

# Label: short identifiers, too common as words to stand alone.
SHORT = {
    "agpl-3.0": ("agpl 3", "agpl"),
    "lgpl-3.0": ("lgpl 3",),
    "gpl-3.0": ("gpl 3",),
    "gpl-2.0": ("gpl 2",),
    "mit": ("mit", "expat", "x11"),
    "isc": ("isc",),
    "zlib": ("zlib libpng", "zlib"),
    "artistic-2.0": ("artistic 2 0",),
    "psf-2.0": ("psf 2 0", "python 2 0", "psf"),
    "postgresql": ("postgresql",),
    "openssl": ("openssl",),
    "ofl-1.1": ("ofl",),
    "cddl-1.0": ("cddl",),
    "cpl-1.0": ("cpl",),
    "eupl-1.2": ("eupl",),
    "apache": ("apache",),
    "lgpl": ("lgpl",),
    "gpl": ("gpl",),
    "mpl": ("mpl",),
    "epl": ("epl",),
    "bsd": ("bsd",),
}

# Statement forms: regular expression with the name as {n}, and score. Earlier forms rank higher.
FORMS = (
    (r"spdx license identifier {n}", 1.0),
    (r"(?:licensed|released|distributed|available|provided|published|redistributed) under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{n}(?: licen[cs]e)?", 0.95),
    (r"(?:under|subject to) the (?:terms|conditions|provisions) of (?:the )?{n}(?: licen[cs]e)?", 0.9),
    (r"(?:covered|governed|protected) by (?:the )?{n}(?: licen[cs]e)?", 0.9),
    (r"licen[cs]e (?:is )?(?:the )?{n}", 0.8),
    (r"(?:copy|text|full text|version) of (?:the )?{n}(?: licen[cs]e)?", 0.7),
    (r"{n}", 0.5),
)

# Distinctive sentences of license texts: label, keyword, expression, score.
SENTENCES = (
    ("mit", "permission", r"permission is hereby granted free of charge to any person obtaining a copy", 1.0),
    ("mit", "noninfringement", r"merchantability fitness for a particular purpose and noninfringement", 0.7),
    ("isc", "permission", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 1.0),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted", 1.0),
    ("bsd-3-clause", "endorse", r"neither the name of (?:\S+ ){1,12}nor the names of its contributors may be used to endorse or promote products", 1.0),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display", 1.0),
    ("apache-2.0", "compliance", r"you may not use this file except in compliance with the license", 0.9),
    ("apache-2.0", "licenses", r"www apache org licenses license 2 0", 1.0),
    ("gpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu general public license", 1.0),
    ("lgpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", 1.0),
    ("agpl-3.0", "affero", r"you can redistribute it and or modify it under the terms of the gnu affero general public license", 1.0),
    ("gpl", "warranty", r"without any warranty without even the implied warranty of merchantability", 0.6),
    ("gpl", "gnu", r"www gnu org licenses(?: gpl\S*)?", 0.8),
    ("mpl-2.0", "mozilla", r"this source code form is subject to the terms of the mozilla public license v 2 0", 1.0),
    ("mpl-2.0", "mozilla", r"mozilla org mpl 2 0", 0.9),
    ("epl-2.0", "eclipse", r"www eclipse org legal epl 2 0", 0.9),
    ("epl-1.0", "eclipse", r"www eclipse org legal epl v10", 0.9),
    ("zlib", "warranty", r"this software is provided as is without any express or implied warranty in no event will the authors", 1.0),
    ("boost-1.0", "boost", r"www boost org license 1 0", 0.9),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", 1.0),
    ("unlicense", "unlicense", r"unlicense org", 0.8),
    ("public-domain", "domain", r"(?:released|placed|dedicated|is) (?:in|into|to) the public domain", 0.8),
    ("cc0-1.0", "publicdomain", r"creativecommons org publicdomain zero 1 0", 1.0),
    ("cc-by-nc-nd-4.0", "creativecommons", r"creativecommons org licenses by nc nd", 1.0),
    ("cc-by-nc-sa-4.0", "creativecommons", r"creativecommons org licenses by nc sa", 1.0),
    ("cc-by-nc-4.0", "creativecommons", r"creativecommons org licenses by nc", 1.0),
    ("cc-by-nd-4.0", "creativecommons", r"creativecommons org licenses by nd", 1.0),
    ("cc-by-sa-4.0", "creativecommons", r"creativecommons org licenses by sa", 1.0),
    ("cc-by", "creativecommons", r"creativecommons org licenses by", 0.9),
    ("ofl-1.1", "font", r"this font software is licensed under the sil open font license", 1.0),
    ("wtfpl", "fuck", r"you just do what the fuck you want to", 1.0),
    ("proprietary", "reserved", r"all rights reserved", 0.4),
    ("proprietary", "confidential", r"(?:proprietary and confidential|confidential and proprietary)", 0.7),
    ("proprietary", "unauthorized", r"unauthorized (?:copying|use|distribution) (?:of this (?:file|software|document) )?(?:via any medium )?is (?:strictly )?prohibited", 0.9),
)


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: bytes
    expression: bytes
    score: float
    rank: int


@dataclass(frozen=True)
class Detection:
    label: str
    first: int
    last: int
    score: float
    rank: int


def rules() -> list[Rule]:
    """All rules in order of priority: sentences, then forms, each over all names and then over the short ones."""
    made = [(label, word, text, score) for label, word, text, score in SENTENCES]
    for form, score in FORMS:
        for label, names in NAMES.items():
            for name in names:
                made.append((label, max(name.split(), key=len), form.replace("{n}", name), score))
        if form != "{n}":
            for label, names in SHORT.items():
                for name in names:
                    made.append((label, max(name.split(), key=len), form.replace("{n}", name), score))
    return [Rule(label, word.encode(), f"(?<= ){text}(?= )".encode(), score, rank) for rank, (label, word, text, score) in enumerate(made)]


class RuleBook:
    """The rules by keyword; an expression is compiled when its keyword is first met."""

    def __init__(self) -> None:
        self.by_keyword: dict[bytes, list[Rule]] = {}
        for r in rules():
            self.by_keyword.setdefault(r.keyword, []).append(r)
        self._compiled: dict[bytes, re.Pattern[bytes]] = {}

    def matches(self, rule: Rule, joined: bytes) -> Iterator[re.Match[bytes]]:
        found = self._compiled.get(rule.expression)
        if found is None:
            found = self._compiled[rule.expression] = re.compile(rule.expression)
        return found.finditer(joined)


def _starts(joined: bytes) -> list[int]:
    """Offset of each word in the word string."""
    starts, at = [], joined.find(b" ")
    while at >= 0 and at + 1 < len(joined):
        starts.append(at + 1)
        at = joined.find(b" ", at + 1)
    return starts


def suppressed(found: list[Detection]) -> list[Detection]:
    """Drop a detection that lies inside the interval of one with a better rank.

    By rank, each detection is kept unless an interval kept so far contains it. Kept intervals are
    no more than the distinct starts, held sorted by start with the furthest end before each.
    """
    kept: list[Detection] = []
    starts: list[int] = []
    reach: list[int] = []
    for d in sorted(found, key=lambda d: (d.rank, d.first, -d.last)):
        k = bisect_left(starts, d.first + 1)
        if k and reach[k - 1] >= d.last:
            continue
        kept.append(d)
        starts.insert(k, d.first)
        reach.insert(k, max(d.last, reach[k - 1] if k else -1))
        for i in range(k + 1, len(reach)):
            if reach[i] >= reach[k]:
                break
            reach[i] = reach[k]
    return sorted(kept, key=lambda d: (d.first, d.last, d.rank))


def detect(text: str, book: RuleBook | None = None) -> tuple[int, list[tuple[str, int]], list[Detection]]:
    """Number of words, base places (label, first word), detections after suppression."""
    words, book = word_bytes(text), book or RuleBook()
    here = book.by_keyword.keys() & set(words)
    if not here:
        return len(words), [], []
    joined = b" " + b" ".join(words) + b" "
    starts = _starts(joined)
    base = []
    for phrase, label in BASE.items():
        sought = b" " + phrase.encode() + b" "
        at = joined.find(sought)
        while at >= 0:
            base.append((label, bisect_left(starts, at + 1)))
            at = joined.find(sought, at + 1)
    found = []
    for k in here:
        for r in book.by_keyword[k]:
            for m in book.matches(r, joined):
                found.append(Detection(r.label, bisect_left(starts, m.start()), bisect_left(starts, m.end()) - 1, r.score, r.rank))
    return len(words), base, suppressed(found)


_RESULT = ("doc_id long, n_words long, base array<struct<label:string,first_word:long>>, "
           "detections array<struct<label:string,first_word:long,last_word:long,score:double>>")
_BASE_TYPE = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64())]))
_FOUND_TYPE = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("score", pa.float64())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    book = RuleBook()
    for batch in batches:
        rows = [detect(t or "", book) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), pa.array([n for n, _, _ in rows], pa.int64()),
            pa.array([[{"label": x, "first_word": i} for x, i in b] for _, b, _ in rows], _BASE_TYPE),
            pa.array([[{"label": d.label, "first_word": d.first, "last_word": d.last, "score": d.score} for d in f] for _, _, f in rows], _FOUND_TYPE)],
            names=["doc_id", "n_words", "base", "detections"])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, ``base`` places, and ``detections`` with label, words covered and score.

    A null text is empty. Rows are independent; nulls, repeated rows, clashing columns and an empty table give
    what each row gives alone. Whole texts are scanned.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scan, _RESULT)
