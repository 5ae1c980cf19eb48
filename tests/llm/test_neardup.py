import random
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from galena.llm import graph, neardup


def shingles(text, words=4):
    w = (text or "").encode().lower().split()
    k = min(words, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def brute(rows, words=4):
    """Component of each doc_id, from all pairs."""
    forest = neardup.Forest()
    sets = [(i, shingles(t, words)) for i, t in rows if i is not None]
    for (a, s), (b, t) in combinations(sets, 2):
        if a == b or s and t and 100 * len(s & t) >= 80 * len(s | t):
            forest.join(a, b)
    least = {}
    for i, _ in sets:
        least[forest.find(i)] = min(i, least.get(forest.find(i), i))
    return {i: least[forest.find(i)] for i, _ in sets}


def near_copies(rng, n, base_words, edits, start, vocabulary=400):
    base = [f"w{rng.randrange(vocabulary)}" for _ in range(base_words)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append((start + i, " ".join(w)))
    return out


def check(spark, make_docs, rows):
    got = neardup.near_duplicates(make_docs(rows)).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    sizes = {i: len(shingles(t)) for i, t in rows}
    for r in got:
        if r["doc_id"] is not None:
            assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == want[r["doc_id"]])
            assert r["n_shingles"] == sizes[r["doc_id"]] or sum(i == r["doc_id"] for i, _ in rows) > 1
    return got


def test_groups_of_all_kinds(spark, make_docs):
    rng = random.Random(5)
    rows = near_copies(rng, 150, 60, 3, 1000) + near_copies(rng, 40, 200, 12, 2000) + near_copies(rng, 30, 30, 2, 3000)
    rows += [(4000 + i, "The SAME text of copies, again and again") for i in range(100)]
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(5000 + i, passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 80)))) for i in range(150)]
    rows += [(6000, None), (6001, ""), (6002, " \n\t"), (6003, "one"), (6004, "ONE"), (6005, "one two"), (6006, "one two three"), (6007, "é É"), (6008, "É É")]
    rows += [(7000, rows[0][1]), (7000, rows[160][1]), (7001, rows[3][1]), (7001, rows[3][1]), (8000, " ".join(f"l{i}" for i in range(60_000)))]
    rng.shuffle(rows)
    check(spark, make_docs, rows)


def test_large_nodes_and_groups(spark, make_docs, monkeypatch):
    """With tiny limits, nodes branch, join and are dealt into groups; nothing is lost."""
    monkeypatch.setattr(neardup, "SMALL", 4)
    monkeypatch.setattr(neardup, "GROUP", 8)
    rng = random.Random(7)
    rows = near_copies(rng, 60, 80, 9, 0) + near_copies(rng, 25, 80, 16, 500)
    passage = " ".join(f"p{i}" for i in range(40))
    rows += [(1000 + i, passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(25))) for i in range(40)]
    check(spark, make_docs, rows)


def test_null_ids_and_empty_table(spark, make_docs):
    assert neardup.near_duplicates(make_docs([])).collect() == [] and neardup.keep(make_docs([])).collect() == []
    text, other = "a b c d e f g h", "q w e r t y u i o p"
    got = neardup.near_duplicates(make_docs([(None, text), (5, text), (None, other), (None, None)])).collect()
    assert sorted((r["doc_id"] is None, r["component_id"] or 0, r["kept"]) for r in got) == [(False, 5, True), (True, 0, True), (True, 0, True), (True, 5, False)]


def test_one_of_each_group_stays(spark, make_docs):
    rng = random.Random(9)
    rows = near_copies(rng, 20, 50, 1, 10) + [(1, "something else entirely and more"), (1, "something else entirely and more"), (None, "no id at all here")]
    docs = make_docs(rows).selectExpr("*", "'clash' AS component_id", "1 AS _gone", "2 AS __gone")
    out = neardup.keep(docs)
    want = brute(rows)
    assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted([*(str(i) for i in set(want.values())), "None"]) and out.columns == docs.columns


def shared_words(rng, n, start, own=20):
    """Texts that share 80 words, with own ones each: similar by about 0.66 at 20 own words, so that none are linked."""
    passage = " ".join(f"p{start}x{i}" for i in range(80))
    return [(start + i, passage + " " + " ".join(f"q{rng.randrange(10**9)}" for _ in range(own))) for i in range(n)]


def test_what_is_compared_grows_in_proportion(spark, make_docs, monkeypatch):
    """Similar documents without links: the rows that are compared in full double with the documents."""
    rng, compared, plain = random.Random(3), {}, neardup.materialize

    def counted(df, label):
        out = plain(df, label)
        if label == "near-picked":
            compared[n] = compared.get(n, 0) + out.count()
        return out

    monkeypatch.setattr(neardup, "materialize", counted)
    for n in (400, 800, 1600):
        got = neardup.near_duplicates(make_docs(shared_words(rng, n, 0))).collect()
        assert len(got) == n and all(r["kept"] for r in got)
    assert 0 < compared[800] <= 2.1 * compared[400] and compared[1600] <= 2.1 * compared[800] and compared[1600] <= 1600 * neardup.TREES


def test_recall_at_the_threshold(spark, make_docs):
    """Pairs just above the threshold, most of them among thousands of similar documents, at the limits as they are."""
    rng = random.Random(11)
    rows = shared_words(rng, 3000, 0)
    pairs = []
    for i in range(400):
        w = rows[7 * i][1].split() if i % 4 else [f"r{rng.randrange(10**9)}" for _ in range(100)]
        a = " ".join(w)
        while True:  # change single words as long as the pair stays linked
            at = rng.randrange(len(w))
            v = [*w[:at], f"x{rng.randrange(10**9)}", *w[at + 1 :]]
            s, t = shingles(a), shingles(" ".join(v))
            if 100 * len(s & t) < 80 * len(s | t):
                break
            w = v
        x, y = 10_000 + 2 * i, 10_001 + 2 * i
        rows += [(x, a + " ")] * (i % 4 == 0) + [(y, " ".join(w))]
        pairs.append((7 * i if i % 4 else x, y))
    label = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(make_docs(rows)).collect()}
    assert sum(label[x] == label[y] for x, y in pairs) >= 0.99 * len(pairs)
    assert sum(label[x] != label[y] for (x, _), (_, y) in zip(pairs, pairs[1:], strict=False)) == len(pairs) - 1


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 40), min_size=1), st.sets(st.integers(0, 40), min_size=1))
def test_links_of_full_sets_are_exact(a, b):
    x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
    assert neardup.linked(x, y) == (100 * len(a & b) >= 80 * len(a | b))


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(2000)], [(500, i) for i in range(999)], [(0, i) for i in range(1, 50)], [(9, 3), (3, 7), (20, 30), (30, 25), (7, 9), (2**62, 5)]])
@pytest.mark.parametrize("few", [0, graph.FEW_EDGES])
def test_components(spark, edges, few, monkeypatch):
    monkeypatch.setattr(graph, "FEW_EDGES", few)
    forest, least = neardup.Forest(), {}
    for a, b in edges:
        forest.join(a, b)
    ends = {x for a, b in edges if a != b for x in (a, b)}
    for x in ends:
        least[forest.find(x)] = min(x, least.get(forest.find(x), x))
    got = graph.components(spark.createDataFrame(edges, "a long, b long"), "t").collect()
    assert {r["id"]: r["component"] for r in got} == {x: least[forest.find(x)] for x in ends} and len(got) == len(ends)


def test_minwise_values_estimate_similarity():
    rng = np.random.default_rng(2)
    same, own = rng.integers(0, 2**63, 800, dtype=np.uint64), rng.integers(0, 2**63, 200, dtype=np.uint64)
    a, b = neardup.minwise(np.unique(same)), neardup.minwise(np.unique(np.concatenate([same, own])))
    assert 0.6 < (a == b).mean() < 0.97
