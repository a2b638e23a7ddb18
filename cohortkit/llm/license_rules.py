"""License scan by ordered signature rules behind a keyword prefilter.

Texts are reduced to their words (A-Z lower-cased, joined by one space).  A
keyword automaton finds which rules can match at all; only those regexes run,
in order of priority.  Of the detections that remain, one whose interval lies
inside a detection of higher priority, or of the same priority and greater
length, is suppressed.  Base phrases are exact word sequences and are always
reported.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .staging import prepare, text_of
from .textwords import LOWER, blocks, byte_table, runs

# Base phrases and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# License families as (label, regex of the name in words, keywords one of which must occur).
FAMILIES = [
    ("agpl", r"(?:gnu )?affero general public licen[cs]e|agpl(?: ?v?[0-9]+)?", ("affero", "agpl")),
    ("lgpl", r"(?:gnu )?(?:lesser|library) general public licen[cs]e|lgpl(?: ?v?[0-9]+)?", ("lesser", "library general", "lgpl")),
    ("gpl", r"(?:gnu )?general public licen[cs]e|gnu gpl|gpl(?: ?v?[0-9]+)?", ("general public", "gpl")),
    ("gfdl", r"gnu free documentation licen[cs]e|gfdl", ("free documentation", "gfdl")),
    ("apache", r"apache (?:software )?licen[cs]e|apache 2 0", ("apache",)),
    ("mit", r"(?:the )?mit(?: x11)? licen[cs]e|expat licen[cs]e", ("mit", "expat")),
    ("bsd", r"(?:new |modified |simplified |revised )?(?:[0-9] clause )?bsd(?: [0-9] clause)?(?: licen[cs]e)?", ("bsd",)),
    ("isc", r"isc licen[cs]e", ("isc",)),
    ("mpl", r"mozilla public licen[cs]e|mpl(?: ?v?[0-9]+)?", ("mozilla", "mpl")),
    ("epl", r"eclipse public licen[cs]e|epl(?: ?v?[0-9]+)?", ("eclipse", "epl")),
    ("eupl", r"european union public licen[cs]e|eupl", ("european union public", "eupl")),
    ("cddl", r"common development and distribution licen[cs]e|cddl", ("common development", "cddl")),
    ("cpl", r"common public licen[cs]e", ("common public",)),
    ("artistic", r"artistic licen[cs]e", ("artistic",)),
    ("zlib", r"zlib(?: libpng)? licen[cs]e", ("zlib",)),
    ("boost", r"boost software licen[cs]e|bsl 1 0", ("boost software", "bsl")),
    ("unlicense", r"unlicense", ("unlicense",)),
    ("wtfpl", r"do what the f[a-z]+ you want to public licen[cs]e|wtfpl", ("do what the", "wtfpl")),
    ("cc0", r"cc0(?: 1 0)?(?: universal)?|creative commons zero", ("cc0", "creative commons zero")),
    ("cc-by-nc-nd", r"(?:cc|creative commons) (?:by nc nd|attribution non ?commercial no ?derivatives|attribution non ?commercial no ?derivs)", ("cc by", "creative commons by", "attribution")),
    ("cc-by-nc-sa", r"(?:cc|creative commons) (?:by nc sa|attribution non ?commercial share ?alike)", ("cc by", "creative commons by", "attribution")),
    ("cc-by-nc", r"(?:cc|creative commons) (?:by nc|attribution non ?commercial)", ("cc by", "creative commons by", "attribution")),
    ("cc-by-nd", r"(?:cc|creative commons) (?:by nd|attribution no ?deriv(?:ative)?s)", ("cc by", "creative commons by", "attribution")),
    ("cc-by-sa", r"(?:cc|creative commons) (?:by sa|attribution share ?alike)", ("cc by", "creative commons by", "attribution")),
    ("cc-by", r"(?:cc|creative commons) (?:by|attribution)", ("cc by", "creative commons by", "attribution")),
    ("odbl", r"open database licen[cs]e|odbl", ("open database", "odbl")),
    ("odc-by", r"open data commons attribution licen[cs]e|odc by", ("open data commons", "odc by")),
    ("pddl", r"public domain dedication and licen[cs]e|pddl", ("public domain dedication", "pddl")),
    ("ofl", r"(?:sil )?open font licen[cs]e|ofl 1 1", ("open font", "ofl")),
    ("ogl", r"open government licen[cs]e", ("open government",)),
    ("psf", r"python software foundation licen[cs]e|psf licen[cs]e", ("python software", "psf")),
    ("php", r"php licen[cs]e", ("php",)),
    ("postgresql", r"postgresql licen[cs]e", ("postgresql",)),
    ("openssl", r"openssl licen[cs]e", ("openssl",)),
    ("sspl", r"server side public licen[cs]e|sspl", ("server side", "sspl")),
    ("busl", r"business source licen[cs]e|busl", ("business source", "busl")),
    ("elastic", r"elastic licen[cs]e", ("elastic",)),
    ("ms-pl", r"microsoft public licen[cs]e|ms pl", ("microsoft public", "ms pl")),
    ("ncsa", r"university of illinois ncsa|ncsa open source licen[cs]e", ("ncsa",)),
    ("rail", r"(?:open ?rail|responsible ai licen[cs]e)", ("rail", "responsible ai")),
    ("bsl", r"bsl licen[cs]e", ("bsl",)),
    ("vim", r"vim licen[cs]e", ("vim",)),
    ("x11", r"x11 licen[cs]e", ("x11",)),
    ("upl", r"universal permissive licen[cs]e", ("universal permissive",)),
    ("afl", r"academic free licen[cs]e", ("academic free",)),
    ("osl", r"open software licen[cs]e", ("open software",)),
]

# How a text states that a license holds, strongest first (score, regex around {name}).
STATEMENTS = [
    (0.98, r"spdx licen[cs]e identifier (?:{name})"),
    (0.95, r"(?:is |are )?(?:licen[cs]ed|released|distributed|published|available|provided) under (?:the )?(?:terms of )?(?:the )?(?:{name})"),
    (0.9, r"(?:subject to|governed by|covered by|under) (?:the )?(?:terms of )?(?:the )?(?:{name})"),
    (0.85, r"(?:{name}) version [0-9]+(?: [0-9]+)?(?: or (?:any )?later)?"),
    (0.85, r"licen[cs]e (?:{name})"),
    (0.8, r"(?:{name}) [0-9]+ [0-9]+(?: (?:international|unported|generic))?"),
    (0.7, r"(?:{name})"),
]

# Clauses that mark a license without naming it (label, score, regex, keywords).
CLAUSES = [
    ("mit", 0.9, r"permission is hereby granted free of charge to any person obtaining a copy", ("permission is hereby granted",)),
    ("isc", 0.85, r"permission to use copy modify and or distribute this software for any purpose", ("permission to use copy",)),
    ("bsd", 0.85, r"redistribution and use in source and binary forms", ("redistribution and use",)),
    ("gpl", 0.85, r"you can redistribute it and or modify it under the terms of the gnu", ("redistribute it and or modify",)),
    ("public-domain", 0.8, r"(?:released|dedicated|placed) (?:in)?to the public domain", ("public domain",)),
    ("public-domain", 0.6, r"(?:is|are) in the public domain", ("public domain",)),
    ("all-rights-reserved", 0.6, r"all rights reserved", ("all rights reserved",)),
    ("all-rights-reserved", 0.5, r"no part of this (?:publication|book|work) may be reproduced", ("no part of this",)),
]


@dataclass(frozen=True)
class Rule:
    label: str
    score: float
    regex: re.Pattern
    keywords: tuple[str, ...]
    priority: int


def rules() -> list[Rule]:
    """All rules in order of priority: families (specific ones first) in every statement, then clauses."""
    out = []
    for family, (label, name, keywords) in enumerate(FAMILIES):
        for score, statement in STATEMENTS:
            regex = re.compile(r"(?<![^ ])" + statement.replace("{name}", name) + r"(?![^ ])")
            out.append(Rule(label, score, regex, keywords, family))
    for label, score, pattern, keywords in CLAUSES:
        out.append(Rule(label, score, re.compile(r"(?<![^ ])(?:" + pattern + r")(?![^ ])"), keywords, len(FAMILIES)))
    return out


#: Bytes of a word: digits, letters and everything beyond ASCII.
WORD_BYTES = byte_table(bytes(range(0x30, 0x3A)) + bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100)))


class LicenseScanner:
    def __init__(self) -> None:
        import ahocorasick

        self.rules = rules()
        by_keyword: dict[str, list[int]] = {}
        for k, rule in enumerate(self.rules):
            for word in rule.keywords:
                by_keyword.setdefault(word, []).append(k)
        for phrase in BASE_PHRASES:
            by_keyword.setdefault(phrase, [])
        self.automaton = ahocorasick.Automaton()
        for word, which in by_keyword.items():
            self.automaton.add_word(word, tuple(which))
        self.automaton.make_automaton()
        self.base = {re.compile(r"(?<![^ ])(?=" + phrase + r"(?![^ ]))"): label for phrase, label in BASE_PHRASES.items()}

    def scan(self, words: str):
        """(base places, detections) of a text of words joined by spaces, one character for each byte.

        A base place is (first word, label); a detection (first word, word
        behind the last, label, score).
        """
        possible = set()
        hit = False
        for _, which in self.automaton.iter(words):
            possible.update(which)
            hit = True
        if not hit:
            return [], []
        spaces = np.flatnonzero(np.frombuffer(words.encode("latin-1"), np.uint8) == 32)

        def word_at(place: int) -> int:
            return int(np.searchsorted(spaces, place))

        base = [(word_at(m.start()), label) for regex, label in self.base.items() for m in regex.finditer(words)]
        found = []
        for k in sorted(possible):
            rule = self.rules[k]
            found += [(rule.priority, m.start() - m.end(), m.start(), m.end(), rule.label, rule.score) for m in rule.regex.finditer(words)]
        return sorted(base), [(word_at(a), word_at(b) + 1, label, score) for a, b, label, score in self.uncovered(found)]

    @staticmethod
    def uncovered(found):
        """Detections that lie in no detection before them, in order of priority and then length.

        One sweep by start: a detection is inside an earlier one of at least
        its priority exactly when such a one that began before reaches its end.
        """
        reach: dict[int, int] = {}
        kept = []
        for priority, minus_length, a, b, label, score in sorted(set(found), key=lambda f: (f[2], f[1], f[0], -f[5], f[4])):
            if any(end >= b for p, end in reach.items() if p <= priority):
                continue
            reach[priority] = max(reach.get(priority, 0), b)
            kept.append((a, b, label, score))
        return kept


def _scan(batches):
    scanner = LicenseScanner()
    for batch in batches:
        out: dict[str, list] = {c: [] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")}
        for _, data, offsets in blocks(batch.column(1)):
            starts, ends = runs(WORD_BYTES[data], offsets)
            # the same bytes with every other byte a space: words stay, keywords can be sought at once
            spaced = np.where(WORD_BYTES[data], LOWER[data], 32).astype(np.uint8).tobytes()
            first = np.searchsorted(starts, offsets)
            for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                words = b" ".join(spaced[offsets[i]:offsets[i + 1]].split()).decode("latin-1")
                base, found = scanner.scan(words)
                miss = 1.0
                for label in {f[2] for f in found}:
                    miss *= 1 - max(f[3] for f in found if f[2] == label)
                out["n_words"].append(b - a)
                out["n_base"].append(len(base))
                out["first_word"].append(min((p for p, _ in base), default=None))
                out["last_word"].append(max((p for p, _ in base), default=None))
                base_labels = {label for _, label in base}
                out["base_labels"].append(",".join(sorted(base_labels)))
                out["labels"].append(",".join(sorted(base_labels | {f[2] for f in found})))
                out["score"].append(round(1 - miss, 6) if found else (0.7 if base else 0.0))
                out["detections"].append([{"first_word": f[0], "end_word": f[1], "label": f[2], "score": f[3]} for f in found])
        detection = pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("label", pa.string()), ("score", pa.float64())])
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(detection)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, k) for v, k in zip(out.values(), kinds))],
                                         names=["doc_id", *out])


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """License statements of every whole text.

    Returns doc_id, n_words, n_base, first_word, last_word (null without a
    base place), base_labels, labels (empty without any), score and
    detections (word intervals with label and score).  A null text is empty;
    rows may repeat and ids may be null; an empty table gives no rows; other
    columns are ignored.
    """
    prepare(docs.sparkSession)
    slim = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))
    return slim.mapInArrow(_scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
                           "labels string, score double, detections array<struct<first_word: long, end_word: long, label: string, score: double>>")
