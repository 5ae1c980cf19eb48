"""Licence scans: Aho-Corasick over the words of a text, and a shunting-yard parser for licence expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame


#: Base phrases. Fixed values.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notice phrases of the method, as words. Fixed values.
NOTICES = {
    "cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc0": "cc0-1.0",
    "creative commons attribution": "cc-by",
    "apache license version 2 0": "apache-2.0",
    "gnu general public license": "gpl",
    "general public license version 2": "gpl-2.0",
    "general public license version 3": "gpl-3.0",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "isc license": "isc",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl-1.0",
    "dedicated to the public domain": "public-domain",
    "all rights reserved": "reserved",
    "proprietary and confidential": "reserved",
}
TAG = "spdx license identifier"
#: How freely a licence lets a text be used, by the start of its label; the first that fits counts.
GRADES = (
    ("cc-by-nc", 0.2), ("cc-by-nd", 0.2), ("cc-by-sa", 0.6), ("cc-by", 0.9), ("cc0", 1.0), ("public-domain", 1.0), ("unlicense", 1.0),
    ("mit", 1.0), ("bsd", 1.0), ("isc", 1.0), ("apache", 1.0), ("bsl", 1.0), ("zlib", 1.0),
    ("mpl", 0.7), ("epl", 0.6), ("lgpl", 0.6), ("gpl", 0.4), ("agpl", 0.3), ("reserved", 0.0),
)
UNKNOWN = 0.5  # of other identifiers
WITH_BONUS = 0.1  # an exception loosens a licence
_TAG_LINE = re.compile(r"spdx-license-identifier[^\S\r\n]*:[^\S\r\n]*([^\r\n]*)", re.I)
_TOKEN = re.compile(r"[^\S\r\n]*([()]|[A-Za-z0-9][A-Za-z0-9.:+-]*)")
_RANK = {"or": 1, "and": 2, "with": 3}
#: All bytes but 0-9, a-z and those of other letters become blanks; A-Z are already in lower case.
_BLANKS = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


class Value(NamedTuple):
    """What an expression comes to: all licences it names, and how freely it lets a text be used."""

    labels: frozenset[str]
    grade: float


def grade(label: str) -> float:
    return next((g for start, g in GRADES if label.startswith(start)), UNKNOWN)


def tokens(line: str) -> list[str]:
    """The tokens at the head of line, up to what can be none."""
    out, at = [], 0
    while m := _TOKEN.match(line, at):
        out.append(m[1])
        at = m.end()
    return out


def to_postfix(line: str) -> list[str]:
    """Shunting-yard: with binds before and, and before or, each from the left. What follows the longest head of line
    that is an expression is left out; [] if there is none."""
    best: list[str] = []
    out: list[str] = []
    ops: list[str] = []
    operand = True  # what may come next
    for t in tokens(line):
        low = t.lower()
        if operand and t == "(":
            ops.append(t)
        elif operand and low not in _RANK and t != ")":
            out.append(low)
            operand = False
        elif not operand and low in _RANK:
            while ops and ops[-1] != "(" and _RANK[ops[-1]] >= _RANK[low]:
                out.append(ops.pop())
            ops.append(low)
            operand = True
        elif not operand and t == ")" and "(" in ops:
            while ops[-1] != "(":
                out.append(ops.pop())
            ops.pop()
        else:
            break
        if not operand and "(" not in ops:
            best = out + ops[::-1]
    return best


def evaluate(postfix: list[str]) -> Value | None:
    """or takes the freer side, and the stricter one; with keeps the licence, loosened by its exception."""
    stack: list[Value] = []
    for t in postfix:
        if t in _RANK and len(stack) >= 2:
            b, a = stack.pop(), stack.pop()
            if t == "with":
                stack.append(Value(a.labels, min(1.0, a.grade + WITH_BONUS)))
            else:
                stack.append(Value(a.labels | b.labels, (max if t == "or" else min)(a.grade, b.grade)))
        else:
            stack.append(Value(frozenset([t]), grade(t)))
    return stack[-1] if stack else None


class Found(NamedTuple):
    n_words: int
    places: list[tuple[int, str]]  # word at which a base phrase begins, phrase
    labels: set[str]
    score: float


def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, TAG}:
        out.add_word(f" {phrase} ", phrase)
    out.make_automaton()
    return out


def scan(text: str | None, finder: ahocorasick.Automaton) -> Found:
    """Words are in lower case (A-Z only), so phrases are found whatever stands between their words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().translate(_BLANKS).split()
    line = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
    places, labels, parts, tagged = [], set(), [], False
    at = word = 0
    hits = sorted((end + 1 - len(phrase) - 2, phrase) for end, phrase in finder.iter(line))
    for start, phrase in hits:
        word, at = word + line.count(" ", at, start), start
        if phrase == TAG:
            tagged = True
            continue
        if phrase in BASE:
            places.append((word, phrase))
            labels.add(BASE[phrase])
        if label := NOTICES.get(phrase):
            labels.add(label)
            parts.append(grade(label))
    if tagged:
        for m in _TAG_LINE.finditer(text):
            if value := evaluate(to_postfix(m[1])):
                labels |= value.labels
                parts.append(value.grade)
    return Found(len(words), places, labels, min(parts, default=0.0))


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, phrases array<string>, starts array<long>"


def license_scan(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and
    the base places as phrases and starts.

    score is the grade of the strictest notice or tagged expression in the text, 0 without any. A null or empty text
    has no words and no labels (an empty string); first_word and last_word are then null. A null doc_id stays null; rows
    are not compared with each other, so repeated rows give repeated results and an empty table an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = automaton()
        for batch in batches:
            found = [scan(t, finder) for t in batch.column("text").to_pylist()]
            starts = [[p[0] for p in f.places] for f in found]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id").cast(pa.int64()),
                "n_words": pa.array([f.n_words for f in found], pa.int64()),
                "n_base": pa.array([len(x) for x in starts], pa.int64()),
                "first_word": pa.array([min(x, default=None) for x in starts], pa.int64()),
                "last_word": pa.array([max(x, default=None) for x in starts], pa.int64()),
                "base_labels": pa.array([",".join(sorted({BASE[p] for _, p in f.places})) for f in found], pa.string()),
                "labels": pa.array([",".join(sorted(f.labels)) for f in found], pa.string()),
                "score": pa.array([f.score for f in found], pa.float64()),
                "phrases": pa.array([[p for _, p in f.places] for f in found], pa.list_(pa.string())),
                "starts": pa.array(starts, pa.list_(pa.int64())),
            })

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def query(docs: DataFrame) -> DataFrame:
    return license_scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
