"""Exact top-k inner products: vectors are bucketed by length, and each bucket is pruned by length or by coordinates."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

#: Vectors whose lengths differ by less than this factor share a class; classes are dealt into buckets of about BUCKET_ROWS.
CLASS_RATIO = 1.05
BUCKET_ROWS, BLOCK_QUERIES = 4096, 2048
#: In a bucket with a local threshold under this, coordinates exclude little, so lengths alone prune: the choice that the
#: method makes for each bucket. Results are the same.
LEAST_COSINE = 0.3
#: Scores that are held at once.
MOST_SCORES = 2_000_000
#: Coordinates of a query that are tried.
FOCUS = 3


class Bucket(NamedTuple):
    """Vectors of one bucket, the longest first, ties by number."""

    ids: np.ndarray
    vectors: np.ndarray  # integers
    lengths: np.ndarray
    units: np.ndarray  # vectors over their lengths; a zero vector stays zero

    @classmethod
    def of(cls, ids: np.ndarray, vectors: np.ndarray) -> Bucket:
        lengths = np.sqrt((vectors.astype(float) ** 2).sum(axis=1))
        order = np.lexsort((ids, -lengths))
        ids, vectors, lengths = ids[order], vectors[order], lengths[order]
        return cls(ids, vectors, lengths, vectors / np.maximum(lengths, 1e-300)[:, None])


def products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact integer products. Doubles are exact below 2**53; beyond, whole numbers of any size are used."""
    most = float(np.abs(vectors).max(initial=0)) * float(np.abs(query).max(initial=0)) * max(1, vectors.shape[1])
    if most < 2**53:
        return (vectors.astype(float) @ query.astype(float)).astype(np.int64)
    if most < 2**63:
        return vectors @ query
    return np.array([sum(int(a) * int(b) for a, b in zip(v, query, strict=True)) for v in vectors], object)


def candidates(bucket: Bucket, query: np.ndarray, length: float, theta: float) -> np.ndarray:
    """Rows of the bucket that may reach a product of theta with the query.

    Length pruning: a vector shorter than theta / length cannot; as the longest come first, that is a prefix. Coordinate
    pruning: with the cosine that the bucket's longest vector would need, t, a unit vector at least that near to the
    query q has in coordinate f a value within t*q_f -+ sqrt((1-t*t)(1-q_f*q_f)), without the upper bound where q_f is at least t
    and the lower one where it is at most -t, as the coordinate's own axis is then that near. Bounds are loosened by
    rounding errors.
    """
    rows = np.arange(len(bucket.ids))
    if theta <= 0 or length == 0 or not len(rows):
        return rows
    need = theta / length * (1 - 1e-9)
    rows = rows[: np.searchsorted(-bucket.lengths, -need, "right")]
    if not len(rows):
        return rows
    t = need / bucket.lengths[0]
    if t >= LEAST_COSINE:
        unit = query / length
        t = min(t, 1.0)
        for f in np.argsort(-np.abs(unit))[:FOCUS]:
            spread = np.sqrt(max(0.0, (1 - t * t) * (1 - unit[f] ** 2))) + 1e-9
            u = bucket.units[rows, f]
            low, high = t * unit[f] - spread, t * unit[f] + spread
            rows = rows[((u >= low) | (unit[f] <= -t)) & ((u <= high) | (unit[f] >= t))]
    return rows


def best(bucket: Bucket, qid: int, query: np.ndarray, k: int, theta: float) -> list[tuple[int, int]]:
    """The k highest (score, id) of the bucket for a query, of those that reach theta; the query itself is left out."""
    length = float(np.sqrt((query.astype(float) ** 2).sum()))
    rows = candidates(bucket, query, length, theta)
    rows = rows[bucket.ids[rows] != qid]
    scores, ids = products(bucket.vectors[rows], query), bucket.ids[rows]
    if scores.dtype != object and len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = scores >= edge
        scores, ids = scores[near], ids[near]
    return [(int(s), int(i)) for s, i in sorted(zip(scores.tolist(), ids.tolist(), strict=True), key=lambda x: (-x[0], x[1]))[:k]]


def search_block(bucket: Bucket, ids: np.ndarray, queries: np.ndarray, theta: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of the bucket, of those that reach theta, for each query of a block: query ids, ids, scores.

    Queries that prune by coordinates are taken one by one; of the others, those with about the same prefix of the bucket
    are multiplied with it together."""
    lengths = np.sqrt((queries.astype(float) ** 2).sum(axis=1))
    need = np.where((theta > 0) & (lengths > 0), theta / np.maximum(lengths, 1e-300) * (1 - 1e-9), -np.inf)
    prefix = np.searchsorted(-bucket.lengths, -need, "right")
    most = float(np.abs(bucket.vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, queries.shape[1])
    alone = need >= LEAST_COSINE * bucket.lengths[0] if most < 2**53 else np.ones(len(ids), bool)
    out: list[tuple[int, int, int]] = []
    for i in np.flatnonzero(alone & (prefix > 0)).tolist():
        out += [(int(ids[i]), x, s) for s, x in best(bucket, int(ids[i]), queries[i], k, float(theta[i]))]
    rest = np.flatnonzero(~alone & (prefix > 0))
    rest = rest[np.argsort(prefix[rest], kind="stable")]
    found = [tuple(np.array(c, np.int64) for c in (zip(*out, strict=True) if out else ((), (), ())))]
    step = max(1, MOST_SCORES // len(bucket.ids))
    for at in range(0, len(rest), step):
        some = rest[at : at + step]
        n = int(prefix[some[-1]])
        scores = queries[some].astype(float) @ bucket.vectors[:n].T.astype(float)  # exact, being below 2**53
        scores[bucket.ids[None, :n] == ids[some, None]] = -np.inf
        edge = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.full(len(some), -np.inf)
        q, x = np.nonzero((scores >= edge[:, None]) & (scores > -np.inf))
        score = scores[q, x].astype(np.int64)
        order = np.lexsort((bucket.ids[x], -score, q))
        q, x, score = q[order], x[order], score[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q, "left") < k
        found.append((ids[some][q[keep]], bucket.ids[x[keep]], score[keep]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one dimension, from the values as they lie in memory."""
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def integers(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id, v (floor(scale * x) of each component as a double), dim, length: vectors without null or non-finite components."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    ok = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    out = vectors.where(F.coalesce(ok, F.lit(False))).select("vec_id", F.transform(v, lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))
    return out.withColumn("dim", F.size("v")).withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))


def top_k(vectors: DataFrame, k: int = 10, query_mod: int = 100, scale: int = 1024) -> DataFrame:
    """For each vector whose id is divisible by query_mod its k best others: query_id, rank (from 1), vec_id, score.

    vectors has vec_id and embedding. Ties go to the smaller vec_id; a query with fewer others gets all. Vectors that are
    null or hold a null or non-finite component take no part, nor do rows without vec_id; only vectors of as many
    components are compared. Repeated rows of an id are candidates each, and none of them for its own id; as queries they
    count once. An empty table gives an empty table.

    Classes of about equal length are dealt by a hash into buckets, so that a length that is frequent fills many. One bucket
    of the longest vectors gives each query a score that its k best must reach. From it and from the query's length
    follows the least class that can reach it; blocks of queries meet the buckets from there on, and the k best
    of each bucket are merged. Lengths of vectors of 64-bit numbers are in about 1,000 classes at most.
    """
    ratio = float(np.log(CLASS_RATIO))
    zero = F.lit(0).cast("long")
    in_class = lambda c: F.floor(F.log(c) / ratio).cast("long")
    rows = integers(vectors, scale)
    rows = materialize(rows.withColumn("class", F.when(F.col("length") > 0, in_class(F.col("length"))).otherwise(F.lit(-1).cast("long"))), "topk-vectors")
    classes = rows.groupBy("dim", "class").agg(F.count("*").alias("n"))
    by_class = Window.partitionBy("dim").orderBy(F.desc(F.when(F.col("n") > k, F.col("class"))), "class")
    classes = classes.withColumn("parts", F.ceil(F.col("n") / BUCKET_ROWS).cast("long")).withColumn("seeds", (F.row_number().over(by_class) == 1) & (F.col("n") > k))
    classes = materialize(classes.select(F.col("dim").alias("_dim"), F.col("class").alias("_class"), "parts", "seeds"), "topk-classes")
    highest = classes.agg(F.coalesce(F.max("_class"), F.lit(-1).cast("long"))).first()[0]
    same = (F.col("dim") == F.col("_dim")) & (F.col("class") == F.col("_class"))
    deal = F.pmod(F.xxhash64("vec_id", F.lit("deal")), F.col("parts"))
    dealt = materialize(rows.join(classes, same).select("vec_id", "v", "dim", "class", deal.alias("part"), "seeds"), "topk-dealt")

    asked = rows.where(F.col("vec_id") % query_mod == 0).dropDuplicates(["vec_id"])
    n_blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    asked = asked.select(F.col("vec_id").alias("query_id"), "v", "length", "dim", F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(n_blocks)).alias("block"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple = ((), (), ())
        if left.num_rows and right.num_rows:
            theta = left.column("theta").to_numpy(zero_copy_only=False).astype(float)
            bucket = Bucket.of(right.column("vec_id").to_numpy(), _matrix(right.column("v")))
            out = search_block(bucket, left.column("query_id").to_numpy(), _matrix(left.column("v")), np.where(np.isnan(theta), -np.inf, theta), k)
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("query_id", "vec_id", "score"), out, strict=True)})

    found = "query_id long, vec_id long, score long"
    # the seeds go to each block of queries: at most BUCKET_ROWS rows of a dimension, once a block
    seeds = dealt.where("seeds AND part = 0").select("vec_id", "v", "dim", F.explode(F.sequence(zero, F.lit(n_blocks - 1).cast("long"))).alias("block"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    reached = asked.withColumn("theta", F.lit(None).cast("double")).groupBy("dim", "block").cogroup(seeds.groupBy("dim", "block")).applyInArrow(search, found)
    reached = reached.withColumn("_r", F.row_number().over(order)).where(F.col("_r") == k).select(F.col("query_id").alias("_q"), F.col("score").cast("double").alias("theta"))

    least = F.when((F.col("theta") > 0) & (F.col("length") > 0), in_class(F.col("theta") / F.col("length")) - 1).otherwise(F.lit(-1).cast("long"))
    wanted = asked.join(reached, F.col("query_id") == F.col("_q"), "left").drop("_q").withColumn("least", F.greatest(least, F.lit(-1).cast("long")))
    wanted = wanted.where(F.col("least") <= highest).withColumn("class", F.explode(F.sequence("least", F.lit(highest).cast("long"))))
    wanted = wanted.join(classes, same).withColumn("part", F.explode(F.sequence(zero, F.col("parts") - 1)))
    wanted = materialize(wanted.select("query_id", "v", "theta", "dim", "class", "part", "block"), "topk-wanted")
    key = ["dim", "class", "part"]
    meets = wanted.groupBy(*key).agg(F.collect_set("block").alias("blocks"))  # of a bucket: one number a block
    theirs = dealt.select("vec_id", "v", *key).join(meets, key).withColumn("block", F.explode("blocks")).drop("blocks")
    out = wanted.groupBy(*key, "block").cogroup(theirs.groupBy(*key, "block")).applyInArrow(search, found)
    out = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(vectors: DataFrame) -> DataFrame:
    return top_k(vectors)


SQL = """
WITH v AS (SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM (SELECT DISTINCT vec_id, v FROM v WHERE vec_id % 100 = 0) q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
