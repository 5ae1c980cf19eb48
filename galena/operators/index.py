"""What an index of a collection is: a way to find neighbours, and the table that it keeps beside the vectors, if any.

A further kind of index is a subclass in INDEXES; a collection asks it for edges to store and for answers.
"""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame

from ..functions.metrics import IndexKind
from ..plans.options import CollectionConfig, QueryOptions
from . import hnsw
from .search import knn_blocks


class VectorIndex(ABC):
    """The index of one configuration. Vectors are slot, id, embedding, norm, live; a table of an index has a column shard,
    and that of slots n * shard_slots and above is found in shards from n on."""

    kind: IndexKind
    #: Whether search() needs a table that build() made.
    stored = True
    shard_slots = hnsw.SHARD_SLOTS

    def __init__(self, config: CollectionConfig):
        self.config = config

    @abstractmethod
    def describe(self) -> str:
        """One line for people."""

    @abstractmethod
    def build(self, vectors: DataFrame) -> DataFrame:
        """The table over all slots."""

    @abstractmethod
    def extend(self, vectors: DataFrame, held: DataFrame, built_slots: int) -> DataFrame:
        """The rows that replace those of shards from built_slots // shard_slots on, after slots were added."""

    @abstractmethod
    def search(self, store: DataFrame, held: DataFrame, queries: DataFrame, options: QueryOptions) -> DataFrame:
        """Neighbours of queries (qid, query): qid, rank, id, slot, score (and metadata)."""

    @abstractmethod
    def integrity(self, held: DataFrame) -> DataFrame:
        """check, violations."""


class FlatIndex(VectorIndex):
    """All vectors are compared; nothing is stored."""

    kind, stored = IndexKind.BRUTE_FORCE, False

    def describe(self) -> str:
        return "brute_force (exact)"

    def build(self, vectors: DataFrame) -> DataFrame:
        return vectors.sparkSession.createDataFrame([], hnsw.EDGES)

    def extend(self, vectors: DataFrame, held: DataFrame, built_slots: int) -> DataFrame:
        return self.build(vectors)

    def search(self, store: DataFrame, held: DataFrame, queries: DataFrame, options: QueryOptions) -> DataFrame:
        return knn_blocks(store, queries, self.config.metric, options, self.config.dimension)

    def integrity(self, held: DataFrame) -> DataFrame:
        return held.sparkSession.createDataFrame([], "check string, violations long")


class GraphIndex(VectorIndex):
    """Graphs over shards of slots."""

    kind = IndexKind.HNSW

    def describe(self) -> str:
        h = self.config.hnsw
        return f"hnsw (M={h.m}, ef_construction={h.ef_construction}, ef_search={h.ef_search}, shards of {self.shard_slots} slots)"

    def build(self, vectors: DataFrame) -> DataFrame:
        return hnsw.build(vectors, self.config.metric, self.config.hnsw, self.shard_slots)

    def extend(self, vectors: DataFrame, held: DataFrame, built_slots: int) -> DataFrame:
        return hnsw.extend(vectors, held, built_slots, self.config.metric, self.config.hnsw, self.shard_slots)

    def search(self, store: DataFrame, held: DataFrame, queries: DataFrame, options: QueryOptions) -> DataFrame:
        return hnsw.search(store, held, queries, self.config.metric, options, self.config.hnsw, self.shard_slots)

    def integrity(self, held: DataFrame) -> DataFrame:
        return hnsw.integrity(held, self.config.hnsw)


INDEXES: dict[IndexKind, type[VectorIndex]] = {i.kind: i for i in (FlatIndex, GraphIndex)}
