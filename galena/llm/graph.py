"""Connected components of an edge table, without gathering it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: When as few edges are left, one task ends the work, in some 10 MB. The components are the same.
FEW_EDGES = 200_000


def labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ends of edges, each once, and the smallest that each reaches."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    low = np.arange(len(ids))
    while True:
        least = np.minimum(low[x], low[y])
        if (low[x] == least).all() and (low[y] == least).all():
            return ids, ids[low]
        np.minimum.at(low, low[x], least)
        np.minimum.at(low, low[y], least)
        while (low[low] != low).any():
            low = low[low]


def _in_one_task(edges: DataFrame) -> DataFrame:
    """edges (a, b), few of them -> x, to: each end with the smallest that it reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches), pa.schema([("a", pa.int64()), ("b", pa.int64())]))
        ids, least = labels(held.column("a").to_numpy(), held.column("b").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(least)], ["x", "to"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, "x long, to long")


def components(edges: DataFrame, label: str) -> DataFrame:
    """edges (a, b: long) -> id, component: each end with the smallest id that it reaches.

    Each round maps every node to the first of itself and its neighbours and contracts the edges so, until few are left.
    First is by id in one round, which ends stars, and by a hash in the next, which leaves about half of any chain; so
    the rounds grow with the logarithm of the longest chain. The rounds' maps are then followed one after the other.
    """
    left = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), f"{label}-edges")
    total: DataFrame | None = None
    turn = 0
    while n := left.count():
        if n <= FEW_EDGES and total is None:
            out = materialize(_in_one_task(left).select(F.col("x").alias("id"), F.col("to").alias("component")), f"{label}-all")
            discard(left)
            return out
        turn += 1

        def rank(c: Column) -> Column:
            by = F.xxhash64(c, F.lit(turn)) if turn % 2 == 0 else F.lit(0).cast("long")  # noqa: B023
            return F.struct(by.alias("by"), c.alias("node"))

        ends = left.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e")).select("e.x", "e.y")
        to = ends.groupBy("x").agg(F.min(rank(F.col("y"))).alias("first")).select("x", F.least("first", rank(F.col("x")))["node"].alias("to"))
        to = materialize(_in_one_task(left) if n <= FEW_EDGES else to, f"{label}-round")
        if total is None:
            after = to.select(F.col("x").alias("id"), F.col("to").alias("component"))
        else:
            after = total.join(to, F.col("component") == F.col("x"), "left").select("id", F.coalesce("to", "component").alias("component"))
        after = materialize(after, f"{label}-map")
        first = left.join(to, F.col("a") == F.col("x")).select(F.col("to").alias("p"), "b")
        both = first.join(to, F.col("b") == F.col("x")).select("p", F.col("to").alias("q")).where("p <> q")
        rest = materialize(both.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct(), f"{label}-edges")
        discard(left, to, *([total] if total else []))
        left, total = rest, after
    if total is None:
        return left.select(F.col("a").alias("id"), F.col("b").alias("component"))
    least = materialize(total.groupBy(F.col("component").alias("_c")).agg(F.min("id").alias("_least")), f"{label}-least")
    out = materialize(total.join(least, F.col("component") == F.col("_c")).select("id", F.col("_least").alias("component")), f"{label}-all")
    discard(left, total, least)
    return out
