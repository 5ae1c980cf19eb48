"""Distances, norms and checks of vectors as column expressions.

A rank key is a double of which smaller is better for every metric: the squared distance for l2 (no root), one minus the
cosine, and the negated inner product. Arithmetic is a left fold in double over float inputs.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F


class Metric(Enum):
    L2 = 0
    COSINE = 1
    DOT = 2

    @property
    def higher_score_is_better(self) -> bool:
        return self is not Metric.L2

    @property
    def title(self) -> str:
        return {Metric.L2: "l2", Metric.COSINE: "cosine", Metric.DOT: "dot"}[self]


#: Names are case-sensitive. Fixed values.
METRIC_NAMES = {"l2": Metric.L2, "l2_squared": Metric.L2, "euclidean": Metric.L2, "cosine": Metric.COSINE, "dot": Metric.DOT}


def parse_metric(name: str) -> Metric | None:
    return METRIC_NAMES.get(name)


class IndexKind(Enum):
    BRUTE_FORCE = 0
    HNSW = 1

    @property
    def title(self) -> str:
        return "brute_force" if self is IndexKind.BRUTE_FORCE else "hnsw"


INDEX_NAMES = {"brute_force": IndexKind.BRUTE_FORCE, "bruteforce": IndexKind.BRUTE_FORCE, "flat": IndexKind.BRUTE_FORCE, "hnsw": IndexKind.HNSW}


def parse_index_kind(name: str) -> IndexKind | None:
    return INDEX_NAMES.get(name)


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda total, x: total + x)


def literal(v: Sequence[float]) -> Column:
    """A vector as a constant array of doubles."""
    return F.lit([float(x) for x in v]) if len(v) else F.array().cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2_squared(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def norm_squared(v: Column) -> Column:
    return dot(v, v)


def norm(v: Column) -> Column:
    """The Euclidean norm; 0 for the empty vector."""
    return F.sqrt(norm_squared(v))


def cosine_key(product: Column, norm_a: Column, norm_b: Column) -> Column:
    """One minus the cosine, which is held within -1 and 1; 1 if a norm is zero, as such a vector is near to nothing."""
    scale = norm_a * norm_b
    return F.when(scale <= 0, F.lit(1.0)).otherwise(F.lit(1.0) - F.least(F.lit(1.0), F.greatest(F.lit(-1.0), product / scale)))


def rank_key(metric: Metric, a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """The rank key of two vectors; norms, where known, save their computation for the cosine."""
    if metric is Metric.L2:
        return l2_squared(a, b)
    if metric is Metric.DOT:
        return -dot(a, b)
    return cosine_key(dot(a, b), norm(a) if norm_a is None else norm_a, norm(b) if norm_b is None else norm_b)


def score(metric: Metric, key: Column) -> Column:
    return {Metric.L2: key, Metric.COSINE: F.lit(1.0) - key, Metric.DOT: -key}[metric]


def key_of_score(metric: Metric, value: Column) -> Column:
    return score(metric, value)  # each conversion is its own inverse


def normalize(v: Column) -> Column:
    """v over its norm, as floats; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n == 0, F.transform(v, lambda x: x.cast("float"))).otherwise(F.transform(v, lambda x: (x.cast("double") / n).cast("float")))


def _bad(x: Column) -> Column:
    return x.isNull() | F.isnan(x) | (F.abs(x) == math.inf)


def is_finite(v: Column) -> Column:
    return ~F.exists(v, _bad)


def first_non_finite(v: Column) -> Column:
    """The index (from 0) of the first NaN, infinity or null; the size of v if there is none."""
    at = F.array_position(F.transform(v, _bad), True)
    return F.when(at > 0, (at - 1).cast("int")).otherwise(F.size(v))


def fault(v: Column, dimension: int) -> Column:
    """Why a vector cannot be stored, or null."""
    i = first_non_finite(v)
    x = F.get(v, i)
    kind = F.when(x.isNull(), "null").when(F.isnan(x), "NaN").when(x > 0, "+Inf").otherwise("-Inf")
    return (
        F.when(v.isNull(), F.lit("vector is null"))
        .when(F.size(v) != dimension, F.concat(F.lit("vector has dimension "), F.size(v), F.lit(f", expected {dimension}")))
        .when(i < F.size(v), F.concat(F.lit("component "), i, F.lit(" is "), kind))
    )
