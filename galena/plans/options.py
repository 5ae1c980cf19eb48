"""Options of queries and configurations of collections and indexes."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass

from ..errors import InvalidArgumentError
from ..functions.metrics import IndexKind, Metric
from .filters import Filter

MAX_DIMENSION = 65_536


@dataclass(frozen=True)
class QueryOptions:
    """What a search returns. ef_search and oversample of 0 mean the default."""

    k: int = 10
    ef_search: int = 0
    filter: Filter = Filter()
    exact: bool = False
    oversample: int = 0
    include_metadata: bool = True

    DEFAULT_OVERSAMPLE = 8

    def __post_init__(self):
        if self.k < 1:
            raise InvalidArgumentError(f"k is {self.k}; it must be at least 1")
        if self.ef_search < 0 or self.oversample < 0:
            raise InvalidArgumentError(f"ef_search {self.ef_search} and oversample {self.oversample} must not be negative")

    @property
    def fetch(self) -> int:
        """Neighbours that an approximate search fetches, so that k are left after the filter."""
        return self.k * (self.oversample or self.DEFAULT_OVERSAMPLE) if self.filter else self.k


@dataclass(frozen=True)
class HnswConfig:
    m: int = 16
    ef_construction: int = 200
    ef_search: int = 64
    seed: int = 42

    def __post_init__(self):
        if not 2 <= self.m <= 512:
            raise InvalidArgumentError(f"M is {self.m}; it must be in [2, 512]")
        if self.ef_construction < 1 or self.ef_search < 1:
            raise InvalidArgumentError(f"ef_construction {self.ef_construction} and ef_search {self.ef_search} must be at least 1")
        if self.ef_construction < self.m:
            raise InvalidArgumentError(f"ef_construction {self.ef_construction} must be at least M {self.m}")

    @property
    def level_multiplier(self) -> float:
        return 1 / math.log(self.m)

    def budget(self, layer: int) -> int:
        """Links a node may have on a layer."""
        return 2 * self.m if layer == 0 else self.m


@dataclass(frozen=True)
class CollectionConfig:
    dimension: int
    metric: Metric = Metric.L2
    index: IndexKind = IndexKind.BRUTE_FORCE
    normalize: bool = False
    hnsw: HnswConfig = HnswConfig()

    def __post_init__(self):
        if not 1 <= self.dimension <= MAX_DIMENSION:
            raise InvalidArgumentError(f"dimension is {self.dimension}; it must be in [1, {MAX_DIMENSION}]")

    def plain(self) -> dict:
        return {"dimension": self.dimension, "metric": self.metric.title, "index": self.index.title, "normalize": self.normalize, "hnsw": asdict(self.hnsw)}

    @classmethod
    def of(cls, plain: dict) -> CollectionConfig:
        from ..functions.metrics import INDEX_NAMES, METRIC_NAMES

        return cls(plain["dimension"], METRIC_NAMES[plain["metric"]], INDEX_NAMES[plain["index"]], plain["normalize"], HnswConfig(**plain["hnsw"]))
