"""Exact nearest neighbours. A store is a DataFrame of slot, id, embedding, norm, live (and metadata, a map).

Ties go to the smaller slot. Filters are applied below the ranking, where they save work; since ranks do not depend on
metadata, the result is that of ranking all and filtering then.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import DimensionMismatchError, InvalidVectorError
from ..functions.metrics import Metric, literal, norm, rank_key, score
from ..plans.options import QueryOptions

#: Query sets up to this many bytes of floats are broadcast whole; larger ones are searched in blocks.
BROADCAST_QUERY_BYTES = 64 << 20
#: Rows of the base that one Arrow batch scores at once, times the block's queries, stay below this many products.
PRODUCTS = 8_000_000
#: Rows of the store that are multiplied at once.
BLOCK_ROWS = 8192
#: The largest k of one query that each task keeps on its own and one task ranks; Spark reserves 2 k places in every task.
TOP_ROWS = 100_000
#: Above, keys are ranked by ranges of about so many rows, of at most so many ranges, from a sample of up to twice so many keys.
RANKED_ROWS, MOST_RANGES, RANGE_SAMPLE = 20_000, 256, 10_000


def check_query(vector: Sequence[float], dimension: int) -> list[float]:
    v = [float(np.float32(x)) for x in vector]
    if len(v) != dimension:
        raise DimensionMismatchError(dimension, len(v), "query")
    for i, x in enumerate(v):
        if not np.isfinite(x):
            raise InvalidVectorError(f"query component {i} is {x}")
    return v


def live(store: DataFrame) -> DataFrame:
    return store.where("live") if "live" in store.columns else store


def _matching(store: DataFrame, options: QueryOptions) -> DataFrame:
    out = live(store)
    return out.where(options.filter.compile(F.col("metadata"))) if options.filter else out


def slot_range(store: DataFrame, first: int, last: int) -> DataFrame:
    """The slots in [first, last); ranges that cover all slots compose into the whole."""
    return store.where((F.col("slot") >= first) & (F.col("slot") < last))


def ranked(keys: DataFrame, k: int, by: str = "qid") -> DataFrame:
    """The k best rows of each query by (rank_key, slot), with rank from 1. Spark keeps k per task before the shuffle."""
    order = Window.partitionBy(by).orderBy("rank_key", "slot")
    return keys.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def merge_top_k(parts: Sequence[DataFrame], k: int) -> DataFrame:
    """The best k per query of several results (qid, slot, rank_key, ...)."""
    out = parts[0].drop("rank")
    for p in parts[1:]:
        out = out.unionByName(p.drop("rank"))
    return ranked(out, k)


def knn(store: DataFrame, query: Sequence[float], metric: Metric, options: QueryOptions = QueryOptions()) -> DataFrame:
    """The nearest neighbours of one query: rank, id, score (and metadata if asked for). One pass and a top-k; above TOP_ROWS
    neighbours, a ranking by ranges."""
    q = literal(query)
    key = rank_key(metric, q, F.col("embedding"), F.lit(float(np.sqrt(sum(float(x) * float(x) for x in query)))), F.col("norm") if "norm" in store.columns else None)
    keep = ["metadata"] if options.include_metadata and "metadata" in store.columns else []
    keys = _matching(store, options).select("slot", "id", key.alias("rank_key"), *keep)
    if options.k > TOP_ROWS:
        return ranked_by_ranges(keys, options.k).select("rank", "id", "slot", score(metric, F.col("rank_key")).alias("score"), *keep)
    top = keys.orderBy("rank_key", "slot").limit(options.k)
    rank = F.row_number().over(Window.orderBy("rank_key", "slot"))  # over k rows
    return top.select(rank.alias("rank"), "id", "slot", score(metric, F.col("rank_key")).alias("score"), *keep)


def _range_of(bounds: Sequence[tuple[float, int]], first: int = 0) -> Column:
    """How many of the rising bounds a row's (rank_key, slot) is not below, by bisection; 0 without a key, as nulls come first."""
    if not bounds:
        return F.lit(first)
    i = len(bounds) // 2
    key, slot = bounds[i]
    below = F.col("rank_key").isNull() | (F.col("rank_key") < key) | ((F.col("rank_key") == key) & (F.col("slot") < slot))
    return F.when(below, _range_of(bounds[:i], first)).otherwise(_range_of(bounds[i + 1 :], first + i + 1))


def ranked_by_ranges(keys: DataFrame, k: int) -> DataFrame:
    """The k best of all rows by (rank_key, slot) in the order of their ranks, for any k: no task holds more than a range.

    Bounds of ranges come from a sample of the keys, which decides about the size of ranges alone. All rows are counted by
    range, and each range is ranked on its own from the sum of those before; ranges from the k-th row on are left out.
    """
    n = keys.count()
    some = keys.where(F.pmod(F.xxhash64("slot"), F.lit(max(1, n // RANGE_SAMPLE))) == 0).where("rank_key IS NOT NULL")
    sample = [(r["rank_key"], r["slot"]) for r in some.select("rank_key", "slot").collect()]
    sample.sort(key=lambda x: (math.isnan(x[0]), 0 if math.isnan(x[0]) else x[0], x[1]))  # as Spark sorts
    parts = min(-(-n // RANKED_ROWS), MOST_RANGES, len(sample))
    rows = keys.withColumn("_range", _range_of([sample[i * len(sample) // parts] for i in range(1, parts)]))
    counts = dict(rows.groupBy("_range").count().collect())
    before = list(accumulate((counts.get(i, 0) for i in range(max(1, parts))), initial=0))
    needed = sum(n < k for n in before[:-1])
    rank = F.row_number().over(Window.partitionBy("_range").orderBy("rank_key", "slot")) + F.get(F.lit(before).cast("array<long>"), F.col("_range"))
    out = rows.where(F.col("_range") < needed).withColumn("rank", rank).where(F.col("rank") <= k)
    return out.withColumn("rank", F.col("rank").cast("int")).drop("_range").orderBy("rank")


def knn_batch(store: DataFrame, queries: DataFrame, metric: Metric, options: QueryOptions = QueryOptions(), where: Column | None = None) -> DataFrame:
    """The nearest neighbours of each query (qid, query): qid, rank, id, slot, score (and metadata).

    The expression form: queries meet the store in a nested loop, of which the queries' side is broadcast, so they must be
    few. where restricts pairs, over qid, query, id, slot. Metadata is joined to the survivors alone.
    """
    base = _matching(store, options)
    q = queries.select("qid", "query", norm(F.col("query")).alias("_qn"))
    pairs = base.select("slot", "id", "embedding", *(["norm"] if "norm" in base.columns else [])).crossJoin(F.broadcast(q))
    if where is not None:
        pairs = pairs.where(where)
    key = rank_key(metric, F.col("query"), F.col("embedding"), F.col("_qn"), F.col("norm") if "norm" in base.columns else None)
    out = ranked(pairs.select("qid", "slot", "id", key.alias("rank_key")), options.k)
    return attach(out, store, metric, options)


def attach(found: DataFrame, store: DataFrame, metric: Metric, options: QueryOptions) -> DataFrame:
    """Scores of survivors, and their metadata if wanted; without it, no join is in the plan."""
    out = found.select("qid", "rank", "id", "slot", score(metric, F.col("rank_key")).alias("score"))
    if options.include_metadata and "metadata" in store.columns:
        meta = store.select(F.col("slot").alias("_slot"), "metadata")
        out = out.join(meta, F.col("slot") == F.col("_slot"), "left").drop("_slot")
    return out


def keys_matrix(metric: Metric, queries: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Rank keys of all pairs, in double."""
    product = queries @ base.T
    if metric is Metric.DOT:
        return -product
    qq, bb = (queries * queries).sum(axis=1), (base * base).sum(axis=1)
    if metric is Metric.L2:
        return np.maximum(qq[:, None] + bb[None, :] - 2 * product, 0)
    scale = np.sqrt(qq)[:, None] * np.sqrt(bb)[None, :]
    return np.where(scale > 0, 1 - np.clip(product / np.where(scale > 0, scale, 1), -1, 1), 1.0)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together to BLOCK_ROWS rows at least, but for the last."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(x.num_rows for x in held) >= BLOCK_ROWS:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def _loose(edge: np.ndarray) -> np.ndarray:
    """A little above, for rounding."""
    return edge + 1e-9 * (1 + np.abs(edge))


def best_rows(keys: np.ndarray, slots: np.ndarray, k: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Query and base row of all pairs among a query's k smallest keys, or within slack of the k-th."""
    if keys.shape[1] <= k:
        q, b = np.indices(keys.shape)
        return q.ravel(), b.ravel()
    edge = np.partition(keys, k - 1, axis=1)[:, k - 1]
    return np.nonzero(keys <= (edge + slack * (1 + np.abs(edge)))[:, None])


def knn_blocks(store: DataFrame, queries: DataFrame, metric: Metric, options: QueryOptions = QueryOptions(), dimension: int | None = None) -> DataFrame:
    """As knn_batch, for many queries: each batch of the store is multiplied with a block of queries at once.

    Queries are gathered once their bytes are known to fit BROADCAST_QUERY_BYTES; beyond, knn_exchange deals both sides.
    The matrix form rounds differently, so each task keeps what is within a slack of its k-th key, and the expression
    form scores these few rows again: results equal knn_batch's.
    """
    n = queries.count()
    if dimension is None:
        first = queries.select(F.size("query").alias("n")).first()
        dimension = first[0] if first else 1
    if n * dimension * 4 > BROADCAST_QUERY_BYTES:
        return knn_exchange(store, queries, metric, options, n)
    table = queries.select("qid", "query").toArrow()
    qids = table.column("qid").to_numpy()
    matrix = table.column("query").combine_chunks().flatten().to_numpy().reshape(n, -1).astype(float) if n else np.empty((0, dimension))
    shared = store.sparkSession.sparkContext.broadcast((qids, matrix))
    k = options.k

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, m = shared.value
        edge = np.full(len(ids), np.inf)  # of each query, a key that its k best of this task do not exceed
        held = []
        for t in _blocks(batches):
            wide = t.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
            base, slots, rows = wide.astype(float), t.column("slot").to_numpy(), t.column("id").to_numpy()
            step = max(1, PRODUCTS // t.num_rows)
            for i in range(0, len(ids), step):
                keys = keys_matrix(metric, m[i : i + step], base)
                part = edge[i : i + step]
                if keys.shape[1] >= k:
                    np.minimum(part, np.partition(keys, k - 1, axis=1)[:, k - 1], out=part)
                q, r = np.nonzero(keys <= _loose(part)[:, None])
                held.append((q + i, keys[q, r], slots[r], rows[r], wide[r]))
        for q, keys, slots, rows, wide in held:
            at = np.flatnonzero(keys <= _loose(edge)[q])
            vectors = wide[at].astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * vectors.shape[1]), pa.array(vectors.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(ids[q[at]]), pa.array(slots[at]), pa.array(rows[at]), lists], ["qid", "slot", "id", "embedding"])

    rows = _matching(store, options).select("slot", "id", "embedding")
    found = rows.mapInArrow(search, "qid long, slot long, id long, embedding array<float>")
    again = found.join(F.broadcast(queries.select("qid", "query")), "qid")
    key = rank_key(metric, F.col("query"), F.col("embedding"))
    return attach(ranked(again.select("qid", "slot", "id", key.alias("rank_key")), k), store, metric, options)


def knn_exchange(store: DataFrame, queries: DataFrame, metric: Metric, options: QueryOptions, n: int, rows_per_block: int = 20_000, queries_per_block: int = 2_000) -> DataFrame:
    """As knn_blocks when the queries are too many to broadcast: blocks of the store meet blocks of queries."""
    base = _matching(store, options).select("slot", "id", "embedding")
    parts, blocks = max(1, -(-base.count() // rows_per_block)), max(1, -(-n // queries_per_block))
    left = queries.select("qid", "query", F.pmod(F.xxhash64("qid"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    right = base.withColumn("part", F.pmod(F.xxhash64("slot"), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    k = options.k

    def search(q: pa.Table, b: pa.Table) -> pa.Table:
        names = ["qid", "slot", "id", "rank_key"]
        if not q.num_rows or not b.num_rows:
            return pa.table({"qid": pa.array([], pa.int64()), "slot": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "rank_key": pa.array([], pa.float64())})
        qm = np.array(q.column("query").to_pylist(), float)
        bm = np.array(b.column("embedding").to_pylist(), float)
        i, j = best_rows(keys_matrix(metric, qm, bm), b.column("slot").to_numpy(), k, 1e-9)
        exact = np.array([_fold(metric, qm[x], bm[y]) for x, y in zip(i, j, strict=True)])
        return pa.table([pa.array(q.column("qid").to_numpy()[i]), pa.array(b.column("slot").to_numpy()[j]), pa.array(b.column("id").to_numpy()[j]), pa.array(exact)], names)

    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(search, "qid long, slot long, id long, rank_key double")
    return attach(ranked(found, k), store, metric, options)


def _fold(metric: Metric, a: np.ndarray, b: np.ndarray) -> float:
    """The rank key by a left fold, as the expressions compute it."""

    def total(v: np.ndarray) -> float:
        return float(np.cumsum(v)[-1]) if len(v) else 0.0

    if metric is Metric.L2:
        return total((a - b) * (a - b))
    product = total(a * b)
    if metric is Metric.DOT:
        return -product
    scale = float(np.sqrt(total(a * a)) * np.sqrt(total(b * b)))
    return 1.0 if scale <= 0 else 1.0 - min(1.0, max(-1.0, product / scale))


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """qid, recall: the part of a query's true neighbours that were found. Both have qid and id."""
    hits = truth.join(found.select("qid", "id").distinct(), ["qid", "id"], "left_semi").groupBy("qid").agg(F.count("*").alias("hits"))
    sizes = truth.groupBy("qid").agg(F.least(F.count("*"), F.lit(k)).alias("n"))
    return sizes.join(hits, "qid", "left").select("qid", (F.coalesce("hits", F.lit(0)) / F.col("n")).alias("recall"))


