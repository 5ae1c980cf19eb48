import math

import numpy as np
import pytest

from galena.llm import topk


def brute(rows):
    ok = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, seen = set(), set()
    for q, v in ok:
        if q % 100 or q in seen:
            continue
        seen.add(q)
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ok if i != q and len(w) == len(v))
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(scores[:10], 1)}
    return out


def run(spark, rows):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    got = topk.query(df).collect()
    assert len(got) == len(set(got))
    return {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got}


@pytest.mark.parametrize("spread", [0.0, 1.5])
def test_against_brute_force(spark, spread, monkeypatch):
    monkeypatch.setattr(topk, "BUCKET_ROWS", 40)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 2)
    rng = np.random.default_rng(4)
    v = rng.normal(size=(600, 6)) * np.exp(spread * rng.normal(size=(600, 1)))
    v[50:120] = v[300]  # a very common vector, which is a query too
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    odd = [(0, [1.0, 2.0]), (100, [0.0, 0.0]), (200, None), (300, [1.0, None]), (400, [math.nan, 1.0]), (500, [math.inf, 1.0]), (600, [1.0]), (700, []), (None, [1.0, 1.0]), (1, [-1.0, -2.0]), (2, [1e9, 1e9]), (800, [3e7, -3e7])]
    assert run(spark, odd) == brute(odd)
    assert run(spark, []) == set() and run(spark, [(0, [1.0])]) == set()
    twice = [(0, [1.0, 1.0]), (0, [1.0, 1.0]), (5, [1.0, 0.0])]
    assert run(spark, twice) == {(0, 1, 5, 1048576)}


def test_pruning_loses_nothing_and_prunes():
    rng = np.random.default_rng(6)
    v = (rng.normal(size=(2000, 8)) * 1000).astype(np.int64)
    bucket = topk.Bucket.of(np.arange(2000), v)
    dropped = 0
    for q in v[:40]:
        s = v @ q
        theta = float(np.sort(s)[-10])
        rows = topk.candidates(bucket, q, float(np.sqrt((q.astype(float) ** 2).sum())), theta)
        assert set(np.flatnonzero(s >= theta)) <= set(bucket.ids[rows])
        dropped += 2000 - len(rows)
    assert dropped > 20_000


def test_products_beyond_doubles_are_exact():
    big = np.array([[3_000_000_001, 7]], np.int64)
    assert topk.products(big, np.array([3_000_000_019, 1]))[0] == 3_000_000_001 * 3_000_000_019 + 7
    huge = np.array([[2**40, 1]], np.int64)
    assert topk.products(huge, np.array([2**30, 5]))[0] == 2**70 + 5
