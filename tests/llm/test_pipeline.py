import corpus_pipeline
from galena.llm import langid, packing, quality
from galena.llm.queries import ORACLES, QUERIES
from tests.llm.test_neardup import brute as components
from tests.llm.test_packing import check_packing


def test_stages_against_brute_force(spark):
    """Each stage's rows follow from its input by the operators' own brute-force versions."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(10_001, None, "en", "s", 0), (10_002, "12 34 !!", None, None, 8)], docs.schema)
    held = docs.unionByName(odd)
    after = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, held, sf)
        assert name == "packing" or out.columns == docs.columns
        rows = [r.asDict() for r in out.collect()]
        after.append(rows)
        held = spark.createDataFrame([tuple(r.values()) for r in rows], out.schema)
    language, clean, single, mixed, packed = after
    assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in language}
    verdicts = {r["doc_id"]: r["kept"] for r in quality.query(spark.createDataFrame([tuple(r.values()) for r in language], docs.schema)).collect()}
    assert {r["doc_id"] for r in clean} == {i for i, k in verdicts.items() if k}
    assert {r["doc_id"] for r in single} == set(components([(r["doc_id"], r["text"]) for r in clean], 5).values())
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in single} and len(mixed) > 0
    words = lambda rows: sum(len(r["text"].split()) for r in rows)
    assert 0.7 < words(mixed) / words(single) < 1.3
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in mixed}
    assert sum(r["length"] for r in packed) == sum(len(packing_ids(r["text"])) for r in mixed)


def packing_ids(text):
    from tests.llm.test_packing import reference_ids

    return reference_ids(text)


def test_all_ten_operators_are_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 11)] and set(ORACLES) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_duplicates", "mixing", "packing"]
    assert langid.UNDETERMINED == "und" and packing.CAPACITY == 4096


def test_run_leaves_the_session_as_it_was(spark):
    """run() packs what its stages keep, each piece once and without gaps, and restores what it sets."""
    sf = "/root/testdata/sf0.001"
    held = spark.conf.get(corpus_pipeline.BATCH)
    rows = corpus_pipeline.run(spark, sf).collect()
    assert spark.conf.get(corpus_pipeline.BATCH) == held
    assert check_packing(rows) >= -(-sum(r["length"] for r in rows) // packing.CAPACITY)
    assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for name in ("op2_language_id", "op6_near_duplicates", "op10_html_extraction"):
        QUERIES[name](spark, sf).collect()
        assert spark.conf.get(corpus_pipeline.BATCH) == held
