import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from galena.llm import license_scan as L

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    places = sorted((i, p) for p in L.BASE for k in [p.split()] for i in range(len(words) - len(k) + 1) if words[i : i + len(k)] == k)
    return len(words), places


@given(st.lists(st.sampled_from(["CC", "cc", "by", "BY.", "general", "public", "License,", "all", "rights", "reserved", "é", "x1", "-", "İ", "_"]), max_size=25), st.sampled_from([" ", "\n", "-", " \x00"]))
def test_places_of_base_phrases(words, gap):
    text = gap.join(words)
    found = L.scan(text, L.automaton())
    assert (found.n_words, sorted(found.places)) == brute(text)


@pytest.mark.parametrize(
    ("line", "labels", "grade"),
    [
        ("MIT", {"mit"}, 1.0), ("MIT OR GPL-2.0-only", {"mit", "gpl-2.0-only"}, 1.0), ("MIT AND GPL-3.0", {"mit", "gpl-3.0"}, 0.4), ("GPL-2.0 WITH Classpath-exception-2.0", {"gpl-2.0"}, 0.5),
        ("MIT OR Apache-2.0 AND GPL-2.0", {"mit", "apache-2.0", "gpl-2.0"}, 1.0), ("(MIT OR Apache-2.0) AND GPL-2.0 */", {"mit", "apache-2.0", "gpl-2.0"}, 0.4), ("mit and (gpl-2.0 or cc-by-4.0", {"mit"}, 1.0), ("MIT OR", {"mit"}, 1.0), ("X-Own", {"x-own"}, 0.5),
    ],
)
def test_expressions(line, labels, grade):
    v = L.evaluate(L.to_postfix(line))
    assert v.labels == labels and v.grade == pytest.approx(grade)


def test_broken_expressions_are_none():
    for line in ("", "OR MIT", "()", ") MIT", "*/"):
        assert L.to_postfix(line) == [] and L.evaluate([]) is None


def test_rows(spark):
    rows = [
        (1, "Licensed under CC BY-NC 4.0."), (2, None), (3, ""), (4, "// SPDX-License-Identifier: MIT OR GPL-3.0\nAll rights reserved. All rights  reserved"), (5, "plain text"), (None, "GNU General Public License, version 3"), (1, "Licensed under CC BY-NC 4.0."), (6, "w " * 200_000 + "cc by"),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, labels string")
    got = {(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], round(r["score"], 3)) for r in L.query(df).collect()}
    assert got == {
        (1, 7, 1, 2, 2, "cc-by", "cc-by,cc-by-nc", 0.2), (2, 0, 0, None, None, "", "", 0.0), (3, 0, 0, None, None, "", "", 0.0), (4, 14, 2, 8, 11, "reserved", "gpl-3.0,mit,reserved", 0.0), (5, 2, 0, None, None, "", "", 0.0),
        (None, 6, 1, 1, 1, "gpl", "gpl,gpl-3.0", 0.4), (6, 200_002, 1, 200_000, 200_000, "cc-by", "cc-by", 0.9),
    }
    assert L.query(df).count() == len(rows) and L.query(df.where("false")).collect() == []
