"""The corpus pipeline: stages over documents, each written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from galena.llm import langid, mixing, neardup, packing, quality
from galena.llm.common import shared_path, table

#: A document whose average word speaks for no language by more than this is rejected, as is one without letters.
LEAST_LANGUAGE_SCORE = 0.4
#: Rows with whole texts that go to Python in one batch, which bounds the memory of executors.
BATCH, TEXT_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 500


def bounded(spark: SparkSession) -> None:
    """Stages are lazy, so the setting stays until run() sets it back."""
    if not 0 < int(spark.conf.get(BATCH)) <= TEXT_ROWS:
        spark.conf.set(BATCH, TEXT_ROWS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language."""
    bounded(spark)
    return langid.keep(docs, LEAST_LANGUAGE_SCORE)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and look like their language."""
    bounded(spark)
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, by shingles of five words."""
    bounded(spark)
    return neardup.keep(docs, words=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    bounded(spark)
    return mixing.repeated(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    bounded(spark)
    return packing.pack_documents(docs)


STAGES = [("language", language), ("quality", quality_rules), ("near_duplicates", near_duplicates), ("mixing", mix_sources), ("packing", pack)]
#: Language scores, set similarity joins and token ids are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    docs, held = table(spark, sf_dir, "documents"), spark.conf.get(BATCH)
    try:
        for name, stage in STAGES:
            path = shared_path(spark, f"pipeline-{name}")
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
    finally:
        spark.conf.set(BATCH, held)
    return docs
