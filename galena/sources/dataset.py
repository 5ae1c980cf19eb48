"""Deterministic vectors: uniform, gaussian or clustered, from a counter-based generator, so that rows are made in parallel."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..errors import InvalidArgumentError

KINDS = ("uniform", "gaussian", "clustered")
# splitmix64, a published generator; its constants are fixed values
GAMMA, MIX_1, MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def splitmix64(seed: int, n: np.ndarray) -> np.ndarray:
    """Outputs number n (from 0) of the generator with a seed: its state before each is seed + (n + 1) * GAMMA."""
    with np.errstate(over="ignore"):
        z = np.uint64(seed % (1 << 64)) + (n.astype(np.uint64) + np.uint64(1)) * np.uint64(GAMMA)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX_1)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX_2)
        return z ^ (z >> np.uint64(31))


def uniforms(seed: int, n: np.ndarray) -> np.ndarray:
    """Floats in [0, 1) of 24 bits."""
    return (splitmix64(seed, n) >> np.uint64(40)).astype(np.float32) * np.float32(2**-24)


def normals(seed: int, n: np.ndarray) -> np.ndarray:
    """Standard normals by Box and Muller; each takes two uniforms."""
    first, second = uniforms(seed, 2 * n), uniforms(seed, 2 * n + 1)
    first = np.where(first > 0, first, np.finfo(np.float32).tiny).astype(np.float32)
    return np.sqrt(np.float32(-2) * np.log(first)) * np.cos(np.float32(2 * np.pi) * second)


@dataclass(frozen=True)
class DatasetSpec:
    """seed places the clusters, sample_seed draws the points. 0 clusters: the root of count, 2 at least."""

    dimension: int = 128
    count: int = 10_000
    seed: int = 42
    sample_seed: int = 42
    kind: str = "clustered"
    clusters: int = 0
    cluster_stddev: float = 0.15

    def __post_init__(self):
        if self.count < 1 or self.dimension < 1:
            raise InvalidArgumentError(f"count {self.count} and dimension {self.dimension} must be at least 1")
        if self.kind not in KINDS:
            raise InvalidArgumentError(f"unknown kind {self.kind!r}; there are {', '.join(KINDS)}")

    @property
    def n_clusters(self) -> int:
        return self.clusters or max(2, int(self.count**0.5))

    def for_queries(self, count: int) -> DatasetSpec:
        """Other points of the same structure."""
        return replace(self, count=count, sample_seed=int(splitmix64(self.sample_seed, np.array([0]))[0]))

    def rows(self, first: int, last: int) -> np.ndarray:
        """Vectors first to last - 1."""
        at = np.arange(first, last, dtype=np.int64)[:, None] * self.dimension + np.arange(self.dimension)
        if self.kind == "uniform":
            return np.float32(-1) + np.float32(2) * uniforms(self.sample_seed, at)
        if self.kind == "gaussian":
            return normals(self.sample_seed, at)
        own = np.arange(first, last, dtype=np.int64) % self.n_clusters
        centre = normals(self.seed, own[:, None] * self.dimension + np.arange(self.dimension))
        return centre + np.float32(self.cluster_stddev) * normals(self.sample_seed, at)


def generate(spark: SparkSession, spec: DatasetSpec) -> DataFrame:
    """id, embedding; each task makes the rows of its own range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("id").to_numpy()
            for part in np.split(ids, np.flatnonzero(np.diff(ids) != 1) + 1) if len(ids) else []:
                rows = spec.rows(int(part[0]), int(part[-1]) + 1).astype(np.float32)
                offsets = np.arange(len(part) + 1, dtype=np.int32) * spec.dimension
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))], ["id", "embedding"])

    return spark.range(spec.count).mapInArrow(run, "id long, embedding array<float>")


def generate_queries(spark: SparkSession, spec: DatasetSpec, count: int) -> DataFrame:
    """qid, query: as many points that the dataset does not hold."""
    return generate(spark, spec.for_queries(count)).toDF("qid", "query")
