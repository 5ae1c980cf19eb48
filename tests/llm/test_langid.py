import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from galena.llm import langid


def test_forward_sums_all_segmentations():
    pieces = langid.vocabulary()
    rng = np.random.default_rng(1)
    prob = rng.random(len(pieces) + 1) * 1e-3
    prob[0] = langid.UNKNOWN
    words = ["▁the", "▁hello", "▁aß☃b", "▁", "ing"]
    lat = langid.lattice(words, pieces, 16)
    got = langid.forward(lat, prob)[lat.length, np.arange(lat.n)]
    for w, g in zip(words, got, strict=True):
        total = 0.0
        for cuts in itertools.product([0, 1], repeat=len(w) - 1):
            at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(w)]
            p = 1.0
            for a, b in itertools.pairwise(at):
                p *= prob[pieces[w[a:b]]] if w[a:b] in pieces else prob[0] if b - a == 1 else 0
            total += p
        assert math.isclose(g, total, rel_tol=1e-9)
    assert np.allclose(langid.backward(lat, prob)[0], got)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.query(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert out[0] > 0.98 and out[1] > 250


def test_held_out_rows_teach_nothing(make_docs):
    rows = [(i, "the cat and the dog" if i % 2 else "der hund und die katze", "en" if i % 2 else "de") for i in range(60)]
    other = [(i, t, "xx" if langid.crc_mod(i) == 1 else g) for i, t, g in rows]
    a, b = (langid.fit(make_docs(r)) for r in (rows, other))
    assert a.langs == b.langs == ["de", "en"] and np.array_equal(a.prob, b.prob)


def test_edges(spark, make_docs):
    rows = [(i, "the cat and the dog" if i % 2 else "der hund und die katze", "en" if i % 2 else "de") for i in range(60)]
    docs = make_docs(rows)
    odd = make_docs([(100, None), (101, ""), (102, "12 $$ _ 34"), (103, "the dog", None), (None, "der hund", None, None), (103, "the dog", None), (104, "x" * 5000 + " the cat and the dog " * 20_000), (105, "漢字" * 100)])
    got = {(r["doc_id"], r["lang_pred"]) for r in langid.predict(odd, langid.fit(docs)).collect()}
    assert {(100, "und"), (101, "und"), (102, "und"), (103, "en"), (None, "de"), (104, "en")} <= got
    scores = [r["score"] for r in langid.predict(odd, langid.fit(docs)).collect()]
    assert all(0 <= s <= 1 for s in scores) and len(scores) == 8
    assert langid.fit(make_docs([(2, "text", None)])) is None
    assert {r["lang_pred"] for r in langid.query(make_docs([(2, "text", None)])).collect()} == {"und"}
    assert langid.query(docs.where("false")).collect() == []
    clash = odd.withColumn("lang_pred", F.lit("clash")).withColumn("score", F.lit("clash"))
    assert dict(langid.predict(clash, langid.fit(docs)).dtypes)["score"] == "double"


def test_held_out_matches_the_checksum(spark):
    df = spark.range(200).select("id", langid.held_out(F.col("id")).alias("h"))
    assert all(r["h"] == (langid.crc_mod(r["id"]) == 1) for r in df.collect())


@pytest.mark.parametrize("n", [39, 40, 41, 95])
def test_long_runs_are_cut_whole(n):
    assert "".join(langid.letters("a" * n)).replace("▁", "") == "a" * n


def test_lattice_against_all_substrings():
    pieces = {p: i for i, p in enumerate(["▁", "▁a", "a", "ab", "b", "abc", "é", "𝒜b", "cab", "▁漢", "字"], 1)}
    words = ["▁abcab", "▁", "ab", "▁漢字𝒜b", "▁xyz", "▁é" + "ab" * 19, "cabcab"] * 3
    want = [(j, w, i, pieces.get(t[i:j], 0)) for w, t in enumerate(words) for j in range(1, len(t) + 1) for i in range(j) if t[i:j] in pieces or i == j - 1]
    lat = langid.lattice(words, pieces, 16)
    assert sorted(want) == list(zip(*(x.tolist() for x in (lat.end, lat.word, lat.start, lat.piece)), strict=True))
    assert langid.lattice([], pieces, 16).n == 0 and lat.length.tolist() == [len(t) for t in words]
