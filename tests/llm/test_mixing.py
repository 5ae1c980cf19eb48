import hashlib
import re
from collections import defaultdict

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from galena.llm import mixing


def brute_targets(sizes):
    """Reshare round by round until no source is above three times its size."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, stopped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in stopped)
        share = sum(weight[s] for s in order if s not in stopped)
        out = {s: 3 * sizes[s] if s in stopped else rest * weight[s] / share for s in order}
        new = {s for s in order if s not in stopped and out[s] > 3 * sizes[s]}
        if not new:
            return out
        stopped |= new


def check(rows, got):
    sizes, words = defaultdict(int), {}
    for i, (_, text, source) in enumerate(rows):
        words[i] = len(re.findall("[^\x20\x09-\x0D]+", text or ""))
        sizes[source] += words[i]
    targets = brute_targets(dict(sizes))
    taken, biggest = defaultdict(int), defaultdict(int)
    groups = defaultdict(int)
    for i, (doc_id, _, source) in enumerate(rows):
        groups[source, doc_id] += words[i]
    for (source, _), n in groups.items():
        biggest[source] = max(biggest[source], n)
    assert len(got) == len(rows)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - targets[r["source"]]) < 1e-6 * (1 + r["target"])
        assert r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[r["source"]] += r["taken"]
    for s, t in taken.items():
        assert abs(t - targets[s]) <= biggest[s] / 2 + 1e-6


def run(spark, rows):
    df = spark.createDataFrame([(*r, i, "clash") for i, r in enumerate(rows)], "doc_id long, text string, source string, size long, copies string")
    return mixing.mix(df).collect()


def test_against_brute_force(spark):
    rows = [(i, "w " * (i * 7 % 23), ["a", "b", "ä", "", None, "B"][i * i % 6]) for i in range(400)]
    rows += [(1000, None, "a"), (1001, "x " * 500, None), (1002, " \t\n", "only blanks"), (None, "n n", "a"), (3, "w w", "a"), (3, "w w", "a"), (4, "big " * 50_000, "b")]
    got = run(spark, rows)
    check(rows, got)
    again = run(spark, rows)
    assert sorted((r["doc_id"] or -1, r["taken"]) for r in got) == sorted((r["doc_id"] or -1, r["taken"]) for r in again)


def test_empty_and_single(spark):
    assert run(spark, []) == []
    check([(1, "a b c", "x")], run(spark, [(1, "a b c", "x")]))
    check([(1, None, "x"), (2, "", None)], run(spark, [(1, None, "x"), (2, "", None)]))


def test_repeated_rows_follow_the_mix(spark):
    df = spark.createDataFrame([(i, "w " * (i % 5 + 1), f"s{i % 4}", "extra") for i in range(100)], "doc_id long, text string, source string, repeats string")
    want = {r["doc_id"]: r["repeats"] for r in mixing.mix(df).collect()}
    got = {r["doc_id"]: r["n"] for r in mixing.repeated(df).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert got == {k: v for k, v in want.items() if v} and mixing.repeated(df).columns == df.columns


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, source string")
    plan = mixing.query(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|RDD", plan.replace("LocalTableScan", "").replace("Scan ExistingRDD", ""))


def test_sql_gives_the_same(spark):
    rows = [(i, "w " * (i * 7 % 23), ["a", "b", "ä", None][i % 4]) for i in range(200)] + [(None, None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    want = sorted((r[0] or -1, r[1], r[2], round(r[3], 6), r[4]) for r in con.execute(mixing.SQL).fetchall())
    assert sorted((r["doc_id"] or -1, r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in mixing.query(df).collect()) == want


@settings(max_examples=100)
@given(st.dictionaries(st.text(max_size=3), st.integers(0, 1000), min_size=1, max_size=9))
def test_targets_use_everything_up_to_the_stop(sizes):
    out = brute_targets(sizes)
    assert abs(sum(out.values()) - sum(sizes.values())) < 1e-6 and all(t <= 3 * sizes[s] + 1e-9 for s, t in out.items())


def test_hash_is_that_of_the_text(spark):
    got = spark.range(3).select(mixing.text_hash60(F.col("id"))).collect()
    assert [r[0] for r in got] == [int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16) for i in range(3)]
