import json
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from galena import cli
from galena.collection import Collection
from galena.errors import DuplicateIdError, InvalidArgumentError, InvalidVectorError, IoError, NotFoundError
from galena.functions.metrics import IndexKind, Metric
from galena.operators import hnsw, search
from galena.plans.filters import Filter
from galena.plans.options import CollectionConfig, HnswConfig, QueryOptions
from galena.sources.dataset import DatasetSpec, generate, generate_queries
from galena.streaming.ingest import ingest


@pytest.fixture
def papers(spark, tmp_path):
    c = Collection.create(spark, str(tmp_path / "c"), CollectionConfig(3, Metric.COSINE))
    rows = [(None, [1, 0, 0], {"field": "finance", "year": 2026}), (None, [0.9, 0.1, 0], {"field": "finance", "year": 2019}), (7, [0.8, 0.2, 0], {"field": "biology", "year": 2026}), (None, [0, 1, 0], {"field": "finance", "year": 2024, "x": None})]
    assert c.insert(c.batch(rows)) == 4
    return c


def ids(df):
    return [r["id"] for r in df.orderBy("rank").collect()]


def test_life_of_a_collection(spark, papers):
    c = papers
    assert [r["id"] for r in c.all_ids().collect()] == [7, 8, 9, 10]
    assert ids(c.search([1, 0, 0], QueryOptions(k=3))) == [8, 9, 7]
    assert ids(c.search([1, 0, 0], QueryOptions(filter=Filter.parse("field == finance and year >= 2024")))) == [8, 10]
    assert [r["id"] for r in c.filter_ids("year == 2026").collect()] == [7, 8]
    assert c.get(10)[1] == {"field": "finance", "x": None, "year": 2024} and c.get(99) is None and c.contains(7)
    with pytest.raises(DuplicateIdError, match="7"):
        c.insert(c.batch([(7, [1, 1, 1], None)]))
    with pytest.raises(InvalidVectorError, match="component 2 is NaN"):
        c.insert(c.batch([(50, [1, 1, 1], None), (51, [1, 1, float("nan")], None)]))
    assert c.size() == 4
    assert c.remove([8, 8, 1000]) == 1 and c.stats()["tombstones"] == 1 and not c.contains(8)
    again = Collection.open(spark, c.path)
    assert ids(again.search([1, 0, 0], QueryOptions(k=2))) == [9, 7]
    assert again.insert(again.batch([(None, [0, 0, 1], None), (8, [0, 0, 2], {"a": 1})])) == 2
    assert [r["id"] for r in again.all_ids().collect()] == [7, 8, 9, 10, 11]
    again.upsert(again.batch([(9, [0, 1, 1], {"new": "y"}), (20, [1, 1, 1], {})]))
    assert again.get(9) == ([0, 1, 1], {"new": "y"})
    again.set_key(9, "k", 2.5)
    again.remove_key(9, "new")
    assert again.get(9)[1] == {"k": 2.5}
    again.set_metadata(9, {})
    assert again.get(9)[1] == {}
    with pytest.raises(NotFoundError):
        again.set_metadata(12345, {"a": 1})
    assert again.compact() == 1 and again.compact() == 0
    slots = [r["slot"] for r in again.vectors().orderBy("slot").collect()]
    assert slots == list(range(6)) and again.check(deep=True) == []
    with pytest.raises(InvalidArgumentError):
        Collection.create(spark, c.path, CollectionConfig(3))
    with pytest.raises(NotFoundError):
        Collection.open(spark, c.path + "-none")


def test_one_writer(papers):
    with papers._writer(), pytest.raises(IoError, match="another writer"):
        papers.remove([7])
    assert papers.remove([7]) == 1


def test_transactions_publish_once_or_not_at_all(spark, papers):
    with papers.transaction() as t:
        t.insert(t.batch([(50, [0, 0, 1], {"a": 1})]))
        with t.transaction():
            t.remove([7])
        assert Collection.open(spark, papers.path).size() == 4
    assert papers.size() == 4 and papers.contains(50) and not papers.contains(7)
    with pytest.raises(DuplicateIdError), papers.transaction() as t:
        t.remove([50])
        t.insert(t.batch([(8, [1, 1, 1], None)]))
    assert papers.contains(50) and Collection.open(spark, papers.path).contains(50)


def test_snapshots_stay_readable(papers):
    before = papers.vectors()
    papers.remove([7])
    assert before.where("live").count() == 4 and papers.size() == 3


def test_import_and_export(spark, papers, tmp_path):
    path = str(tmp_path / "out.vecs")
    assert papers.export_file(path) == 4
    other = Collection.create(spark, str(tmp_path / "d"), CollectionConfig(3))
    assert other.import_file(path) == 4 and other.import_file(path, start_id=100) == 4
    assert [r["id"] for r in other.all_ids().collect()] == [7, 8, 9, 10, 100, 101, 102, 103]


@pytest.fixture(scope="module")
def clustered(spark):
    spec = DatasetSpec(dimension=32, count=1_200, seed=17, clusters=30)
    s = generate(spark, spec).select(F.col("id").alias("slot"), "id", "embedding", F.lit(1.0).alias("norm"), F.lit(True).alias("live")).cache()
    return s, generate_queries(spark, spec, 20).cache()


@pytest.mark.parametrize(("metric", "least"), [(Metric.L2, 0.98), (Metric.COSINE, 0.98), (Metric.DOT, 0.4)])
def test_graph_recall(clustered, metric, least):
    s, q = clustered
    s = s.drop("norm")
    config, o = HnswConfig(m=16, ef_construction=100, ef_search=100), QueryOptions(include_metadata=False)
    edges = hnsw.build(s, metric, config, shard_slots=500).cache()
    assert hnsw.integrity(edges, config).agg(F.sum("violations")).first()[0] == 0
    found = hnsw.search(s, edges, q, metric, o, config, shard_slots=500)
    assert search.recall(found, search.knn_blocks(s, q, metric, o), 10).agg(F.avg("recall")).first()[0] > least


def test_each_query_finds_nine_of_ten_in_a_large_store(spark, tmp_path, monkeypatch):
    """On vectors without structure, a walk of few nodes misses neighbours in a shard that is much larger."""
    from galena import queries

    v = np.random.default_rng(3).normal(size=(2_000, 64))
    spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<float>").withColumn("label", F.lit(0)).write.parquet(str(tmp_path / "embeddings.parquet"))
    config = HnswConfig(m=12, ef_construction=30, ef_search=40)
    monkeypatch.setattr(queries, "HnswConfig", lambda **_: config)  # smaller than the query's, for a smaller table
    got = queries.ann_recall(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(i, True) for i in range(0, 2_000, 50)]


def test_graphs_repeat_and_thin(clustered):
    s, _ = clustered
    config = HnswConfig(m=4, ef_construction=20)
    a, b = (sorted((r["node"], r["layer"], tuple(r["neighbours"])) for r in hnsw.build(s, Metric.L2, config).collect()) for _ in range(2))
    assert a == b
    n = np.bincount([layer for _, layer, _ in a])
    assert len(n) >= 3 and all(0.01 < y / x < 0.5 for x, y in zip(n[:3], n[1:3], strict=False))


def test_indexed_collection(spark, tmp_path):
    c = Collection.create(spark, str(tmp_path / "h"), CollectionConfig(8, Metric.L2, IndexKind.HNSW, hnsw=HnswConfig(m=8, ef_construction=40)))
    rows = generate(spark, DatasetSpec(dimension=8, count=300, clusters=10)).withColumn("metadata", F.create_map(F.lit("rare"), F.struct(F.lit(1).cast("byte").alias("t"), (F.col("id") % 20).alias("i"), F.lit(None).cast("double").alias("r"), F.lit(None).cast("string").alias("s"))))
    c.insert(rows)
    assert c.stats()["dirty"]
    c.flush()
    assert not c.stats()["dirty"] and c.check(deep=True) == []
    q = c.get(5)[0]
    assert ids(c.search(q, QueryOptions(k=5))) == ids(c.search(q, QueryOptions(k=5, exact=True)))
    assert len(ids(c.search(q, QueryOptions(k=5, exact=True, filter=Filter.parse("rare == 1"))))) == 5
    c.remove([5])
    assert 5 not in ids(c.search(q, QueryOptions(k=5)))
    shutil.rmtree(c._state["edges"][0].removeprefix("file:"))
    assert Collection.open(spark, c.path).check(deep=True) == []


def links(df):
    return sorted((r["shard"], r["node"], r["layer"], tuple(r["neighbours"])) for r in df.collect())


@pytest.fixture
def graphed(spark, tmp_path):
    """A collection with a graph over 150 slots, in shards of 100."""
    c = Collection.create(spark, str(tmp_path / "g"), CollectionConfig(8, Metric.L2, IndexKind.HNSW, hnsw=HnswConfig(m=6, ef_construction=30)))
    c.index.shard_slots = 100
    rows = generate(spark, DatasetSpec(dimension=8, count=330, clusters=10)).cache()
    c.insert(rows.where("id < 150"))
    c.flush()
    return c, rows


def test_inserts_are_added_to_the_graph(graphed):
    c, rows = graphed
    before = c._state["edges"]
    c.insert(rows.where("id >= 150 AND id < 160"))
    c.insert(rows.where("id >= 160"))
    c.flush()
    assert c._state["edges"][0] == before[0] and c._state["edges_from"] == [0, 1] and c.check(deep=True) == []
    whole = links(hnsw.build(c.vectors(), Metric.L2, c.config.hnsw, 100))
    assert links(c.edges()) == whole and {s for s, *_ in whole} == {0, 1, 2, 3}
    c.insert(c.batch([(None, [0.5] * 8, None)]))
    q = c.get(200)[0]
    assert ids(c.search(q, QueryOptions(k=5, ef_search=100))) == ids(c.search(q, QueryOptions(k=5, exact=True)))
    assert c._state["edges_from"] == [0, 1, 3] and not c.stats()["dirty"]
    c.upsert(c.batch([(3, [9.0] * 8, None)]))
    assert ids(c.search([9.0] * 8, QueryOptions(k=1))) == [3] and c._state["edges_from"] == [0]


def test_search_while_another_writes(spark, graphed):
    c, rows = graphed
    other = Collection(spark, c.path, c._read_state(spark, c.path))
    c.insert(rows.where("id >= 150"))
    late = Collection(spark, c.path, c._read_state(spark, c.path))
    with other._writer():
        assert ids(late.search(late.get(300)[0], QueryOptions(k=3))) == ids(late.search(late.get(300)[0], QueryOptions(k=3, exact=True)))


@pytest.mark.parametrize(("change", "why"), [("slice(neighbours, 1, 0)", None), ("array(node)", "to itself"), ("array(9999L)", "no slot"), ("transform(sequence(1, 50), x -> cast(x AS long))", "links")])
def test_damaged_graphs_are_refused(graphed, change, why):
    c, _ = graphed
    path = f"{c.path}/edges-damaged"
    c.edges().selectExpr("shard", "node", "layer", f"CASE WHEN node = 60 AND layer = 0 THEN {change} ELSE neighbours END AS neighbours").write.parquet(path)
    fs, old = c._fs(c.spark, c._state["edges"][0])
    fs.delete(old, True)
    fs.rename(c._fs(c.spark, path)[1], old)
    assert any("checksum" in m for _, m in c.check(deep=True))
    if why:
        with pytest.raises(Exception, match=why):
            c.search([0.0] * 8, QueryOptions(k=3)).collect()


def test_checksums_sizes_and_vacuum(spark, papers):
    c = papers
    assert c.stats()["vectors_file_bytes"] > 0 and c.stats()["index_bytes"] == 0 and c.stats()["describe"].startswith("brute_force")
    c.remove([7, 8, 9, 10])
    assert c.check(deep=True) == [] and c.size() == 0
    used = {*c._state["vectors"], *c._state["metadata"]}
    assert c.vacuum() == 0 and c.vacuum(0) > 0 and c.vacuum(0) == 0
    c.insert(c.batch([(70, [1, 2, 3], {"a": 1, "b": "x"}), (71, [1, 2, 4], None)]))
    assert c.check(deep=True) == [] and c.size() == 2 and used <= {*c._state["vectors"], *c._state["metadata"]}
    table = c._state["vectors"][-1]
    spark.read.parquet(table).where("id = 70").write.parquet(table + "-x")
    fs, old = c._fs(spark, table)
    fs.delete(old, True)
    fs.rename(c._fs(spark, table + "-x")[1], old)
    assert any("rows that were written" in m for _, m in c.check())


def test_graph_search_by_parts_of_queries(clustered):
    s, q = clustered
    config = HnswConfig(m=8, ef_construction=40)
    edges = hnsw.build(s, Metric.L2, config, shard_slots=500).cache()
    a, b = (sorted(map(tuple, hnsw.search(s, edges, q, Metric.L2, QueryOptions(include_metadata=False), config, 500, parts).collect())) for parts in (None, 3))
    assert a == b and len(a) == 200


def test_stream(spark, tmp_path):
    c = Collection.create(spark, str(tmp_path / "s"), CollectionConfig(2))
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, embedding array<float>")
    for change in (1, 2):
        rows.selectExpr("id", f"transform(embedding, x -> cast(x * {change} as float)) AS embedding").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ingest(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), c, str(tmp_path / "cp")).awaitTermination()
    assert c.size() == 2 and c.get(1)[0] == [2.0, 0.0]


def test_command_line(spark, tmp_path, capsys):
    path = str(tmp_path / "cli")

    def call(*a):
        code = cli.main(["--json", *a])
        return code, json.loads(capsys.readouterr().out or "null")

    assert call("create", path, "--dimension", "2", "--metric", "cosine")[0] == 0
    assert call("insert", path, "--vector", "1,0", "--meta", "a=1", "--meta", 'b="2"') == (0, {"insert": 1, "id": 0})
    assert call("insert", path, "--vector", "[-1 0.5]", "--id", "5")[0] == 0
    code, out = call("search", path, "--vector", "1 0.1", "-k", "1")
    assert code == 0 and out["results"][0]["id"] == 0 and out["results"][0]["metadata"] == {"a": 1, "b": "2"}
    assert call("get", path, "--id", "5")[1]["vector"] == [-1, 0.5]
    assert call("delete", path, "--id", "77")[0] == 1
    assert call("check", path, "--deep") == (0, {"issues": []})
    assert call("stats", path)[1]["live_vectors"] == 2
    assert cli.main(["search", path]) == 2 and cli.main(["nonsense"]) == 2
    assert cli.main(["insert", path, "--vector", "1,2,3"]) == 1
