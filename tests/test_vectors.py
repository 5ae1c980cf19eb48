import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from galena.errors import CorruptionError, DimensionMismatchError, InvalidVectorError, UnsupportedVersionError
from galena.functions import metrics as D
from galena.functions.metrics import Metric
from galena.operators import search
from galena.plans.filters import Filter
from galena.plans.options import QueryOptions
from galena.sources import vecs
from galena.sources.csvs import parse_literal, read_csv, write_csv
from galena.sources.dataset import DatasetSpec, generate, generate_queries, splitmix64

PLANE = [(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [3.0, 4.0]), (4, [-1.0, 0.0])]
PLAIN = QueryOptions(k=3, include_metadata=False)


def store(spark, rows):
    df = spark.createDataFrame(rows, "slot long, embedding array<float>")
    return df.select("slot", F.col("slot").alias("id"), "embedding", D.norm(F.col("embedding")).alias("norm"), F.lit(True).alias("live"))


def test_plane(spark):
    got = search.knn(store(spark, PLANE), [0.1, 0.0], Metric.L2, PLAIN).collect()
    assert [r["id"] for r in got] == [0, 1, 2]
    assert [round(r["score"], 9) for r in got] == [0.01, 0.81, 1.01]
    assert search.knn(store(spark, PLANE), [0.1, 0.0], Metric.L2, QueryOptions(k=100, include_metadata=False)).count() == 5


def test_more_neighbours_than_a_task_holds(spark, monkeypatch):
    """Spark reserves places for k rows in each task, so a k of a billion takes another way; its ranks are the same."""
    monkeypatch.setattr(search, "RANKED_ROWS", 100)
    rng = np.random.default_rng(5)
    s = store(spark, [(i, v) for i, v in enumerate(rng.integers(-2, 3, (1_000, 3)).astype(float).tolist())])  # many exact ties
    plain = s.select("slot", (D.dot(D.literal([1.0, 0.5, -1.0]), F.col("embedding"))).alias("key")).collect()
    want = [r["slot"] for r in sorted(plain, key=lambda r: (-r["key"], r["slot"]))]
    for k, n in ((1_000_000_000, 1_000), (search.TOP_ROWS + 1, 1_000)):
        got = search.knn(s, [1.0, 0.5, -1.0], Metric.DOT, QueryOptions(k=k, include_metadata=False))
        assert "TakeOrdered" not in got._jdf.queryExecution().executedPlan().toString()
        assert [(r["rank"], r["id"]) for r in got.collect()] == list(enumerate(want[:n], 1)) and got.schema["rank"].dataType.typeName() == "integer"
    monkeypatch.setattr(search, "TOP_ROWS", 10)
    for k in (11, 350, 999):
        assert [r["id"] for r in search.knn(s, [1.0, 0.5, -1.0], Metric.DOT, QueryOptions(k=k, include_metadata=False)).collect()] == want[:k]
    assert search.knn(s.where("slot < 0"), [1.0, 0.5, -1.0], Metric.DOT, QueryOptions(k=11, include_metadata=False)).collect() == []


def test_zero_vectors_are_near_to_nothing(spark):
    got = search.knn(store(spark, PLANE), [2.0, 0.0], Metric.COSINE, QueryOptions(k=5, include_metadata=False)).collect()
    assert [(r["id"], round(r["score"], 9)) for r in got] == [(1, 1.0), (3, 0.6), (0, 0.0), (2, 0.0), (4, -1.0)]


@pytest.mark.parametrize("metric", Metric)
def test_all_forms_of_the_batch_search_agree_with_brute_force(spark, metric):
    rng = np.random.default_rng(metric.value)
    base = rng.integers(-2, 3, (300, 5)).astype(float)  # few values: many exact ties
    q = rng.integers(-2, 3, (17, 5)).astype(float)
    s = store(spark, [(i, v.tolist()) for i, v in enumerate(base)])
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "qid long, query array<float>")
    o = QueryOptions(k=7, include_metadata=False)
    want = {}
    for i, x in enumerate(q):
        keys = [(search._fold(metric, x, y), j) for j, y in enumerate(base)]
        want |= {(i, r): j for r, (_, j) in enumerate(sorted(keys)[:7], 1)}
    for got in (search.knn_batch(s, queries, metric, o), search.knn_blocks(s, queries, metric, o), search.knn_exchange(s, queries, metric, o, 17, 100, 5)):
        assert {(r["qid"], r["rank"]): r["id"] for r in got.collect()} == want


def test_plan_of_a_filtered_search_reads_what_it_needs(spark, tmp_path):
    path = str(tmp_path / "s")
    store(spark, PLANE).write.parquet(path)
    s = spark.read.parquet(path)
    plan = search.knn(s, [0.1, 0.0], Metric.L2, PLAIN)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "metadata" not in plan
    assert "PushedFilters: [IsNotNull(live), EqualTo(live,true)]" in plan


def test_filter_below_the_ranking(spark):
    from galena.functions import metadata as M

    s = store(spark, PLANE).withColumn("metadata", M.metadata_map({"even": M.int_value((F.col("id") % 2 == 0).cast("long"))}))
    o = QueryOptions(k=2, filter=Filter.parse("even == 1"))
    assert [r["id"] for r in search.knn(s, [0.9, 0.0], Metric.L2, o).collect()] == [0, 2]


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([float("nan"), 1.0],), ([1.0, -math.inf],), ([1.0],), (None,), ([],)], "v array<float>")
    rows = df.select(D.norm(df.v).alias("n"), D.normalize(df.v).alias("u"), D.fault(df.v, 2).alias("f"), D.first_non_finite(df.v).alias("i")).collect()
    assert rows[0]["n"] == 5 and np.allclose(rows[0]["u"], [0.6, 0.8]) and rows[1]["u"] == [0, 0] and rows[6]["n"] == 0
    assert [r["f"] for r in rows] == [None, None, "component 0 is NaN", "component 1 is -Inf", "vector has dimension 1, expected 2", "vector is null", "vector has dimension 0, expected 2"]
    assert [r["i"] for r in rows][:5] == [2, 2, 0, 1, 1]


@pytest.mark.parametrize("name", ["vector_normalize", "rank_key_pairs", "knn_k_exceeds_n", "literal_parse", "export_order", "upsert_merge"])
def test_what_rounds_to_zero_has_the_sign_that_sql_gives(spark, tmp_path, name):
    import duckdb

    from galena import queries

    rows = []
    for i in range(22):
        v = [0.0] * 64
        v[0], v[i % 8], v[63] = -2e-8, 1.0, -1e-9 * (i - 5)
        rows.append((i, v, i % 4 - 1))  # label -1 makes zero vectors
    path = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(path)
    got = queries.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{path}/*.parquet')")
    want = con.execute(queries.ORACLES[name])
    at = [got.columns.index(d[0]) for d in want.description]
    sql = sorted(map(repr, want.fetchall()))  # -0.0 is not 0.0 as text
    assert sorted(repr(tuple(r[i] for i in at)) for r in got.collect()) == sql
    assert any("-0.0" in r for r in sql)


def test_queries_are_checked():
    with pytest.raises(DimensionMismatchError, match="3, expected 2"):
        search.check_query([1, 2, 3], 2)
    with pytest.raises(InvalidVectorError, match="component 1"):
        search.check_query([1, math.nan], 2)


def test_vecs_round_trip_and_damage(spark, tmp_path):
    path = str(tmp_path / "a.vecs")
    df = spark.createDataFrame([(7, [1.5, -2.0]), (3, [0.1, 1e-30])], "id long, embedding array<float>")
    vecs.write_vecs(df, path)
    assert vecs.read_header(path) == (2, 2, True)
    back = vecs.read_vecs(spark, path).orderBy("ordinal").collect()
    assert [(r["ordinal"], r["id"]) for r in back] == [(0, 3), (1, 7)] and np.array_equal(np.float32(back[0]["embedding"]), np.float32([0.1, 1e-30]))
    raw = open(path, "rb").read()
    for data, error, what in ((raw[:20], CorruptionError, "fewer"), (raw[:-1], CorruptionError, "truncated"), (raw + b"x", CorruptionError, "follow"), (b"X" + raw[1:], CorruptionError, "begins"), (raw[:12] + b"\x03" + raw[13:], CorruptionError, "checksum"), (raw[:8] + b"\x02" + raw[9:], UnsupportedVersionError, "version 2")):
        (tmp_path / "b.vecs").write_bytes(data)
        with pytest.raises(error, match=what):
            vecs.read_header(str(tmp_path / "b.vecs"))
    vecs.write_vecs(df.where("false"), path)
    assert vecs.read_vecs(spark, path).collect() == []


def test_csv_round_trip_and_damage(spark, tmp_path):
    df = spark.createDataFrame([(7, [0.1, -2.0]), (3, [1e-30, 3.0])], "id long, embedding array<float>")
    write_csv(df, str(tmp_path / "c"))
    back = read_csv(spark, str(tmp_path / "c"), ids=True).orderBy("ordinal").collect()
    assert [r["id"] for r in back] == [3, 7] and np.array_equal(np.float32(back[1]["embedding"]), np.float32([0.1, -2.0]))
    f = tmp_path / "d.csv"
    f.write_text("# head\n\n1, 2,3\n4,5\n")
    with pytest.raises(CorruptionError, match="line 4"):
        read_csv(spark, str(f))
    f.write_text("1,2,3\n4,x,6\n")
    with pytest.raises(CorruptionError, match="line 2"):
        read_csv(spark, str(f))


def test_literals():
    assert parse_literal("[1, 2.5  -3]") == [1, 2.5, -3]
    with pytest.raises(InvalidVectorError, match="component 1"):
        parse_literal("1,x")


def test_generator(spark):
    assert [int(x) for x in splitmix64(0, np.arange(2))] == [0xE220A8397B1DCDAF, 0x6E789E6AA1B965F4]  # published outputs
    spec = DatasetSpec(dimension=4, count=50, clusters=5)
    rows = {r["id"]: r["embedding"] for r in generate(spark, spec).repartition(3).collect()}
    assert np.allclose([rows[i] for i in range(50)], spec.rows(0, 50))
    assert not np.allclose(generate_queries(spark, spec, 5).orderBy("qid").first()["query"], rows[0])
    assert spec.rows(0, 50)[::5].std(axis=0).max() < 0.5
