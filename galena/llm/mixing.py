"""Mixing sources to target weights by hash-threshold histograms. DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import WORD, materialize, text_hash60

HASH_BITS = 60
#: Bits of the hash that one histogram resolves; two histograms, then single hash values.
STEP = 12
#: As many rows of the table of sources at most are broadcast. With more, the join shuffles, and AQE splits hot sources.
BROADCAST_SOURCES = 20_000


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], max_repeat: int) -> DataFrame:
    """source, source_size -> the same with target. One row per source comes in; they meet in one task, as the
    weights go round in the order of all sources.

    With the sources ordered by the level at which each reaches its stop, source i stops below the level
    that the rest would share if all before it had stopped.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    stop = F.col("source_size") * F.lit(max_repeat)
    level = Window.orderBy("_r", F.col("source").asc_nulls_last())
    whole = Window.partitionBy(F.lit(0))
    out = (
        sizes.withColumn("_w", weight)
        .withColumn("_r", stop.cast("double") / F.col("_w"))
        .withColumn("_total", F.sum("source_size").over(whole))
        .withColumn("_before", F.coalesce(F.sum(stop).over(level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_left", F.sum("_w").over(level.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_stopped", F.col("_r") < (F.col("_total") - F.col("_before")) / F.col("_left"))
    )
    rest = F.col("_total") - F.sum(F.when(F.col("_stopped"), stop).otherwise(0)).over(whole)
    shares = F.sum(F.when(F.col("_stopped"), 0.0).otherwise(F.col("_w"))).over(whole)
    return out.withColumn("target", F.when(F.col("_stopped"), stop.cast("double")).otherwise(rest.cast("double") * F.col("_w") / shares)).select("source", "source_size", "target")


def _boundary(rows: DataFrame, key: F.Column, budgets: DataFrame) -> DataFrame:
    """The first value of key at which a source's running size passes its budget. budgets: source, _budget, _before.
    Gives source, _budget, _before (the size below that value), _at, _size (at it); no row where none passes."""
    run = Window.partitionBy("source").orderBy("_at")
    sums = rows.groupBy("source", key.alias("_at")).agg(F.sum("size").alias("_size"))
    sums = sums.withColumn("_run", F.sum("_size").over(run))
    sums = sums.withColumnRenamed("source", "_source").join(budgets, F.col("_source").eqNullSafe(F.col("source"))).drop("_source")
    sums = sums.where(F.col("_before") + F.col("_run") > F.col("_budget"))
    first = sums.groupBy("source").agg(F.min_by(F.struct("_budget", "_before", "_run", "_at", "_size"), "_at").alias("_x"))
    return first.select("source", "_x._budget", (F.col("_x._before") + F.col("_x._run") - F.col("_x._size")).alias("_before"), "_x._at", "_x._size")


def _within(rows: DataFrame, found: DataFrame, shift: int) -> DataFrame:
    """The rows of the boundary bucket of each source."""
    f = found.select(F.col("source").alias("_source"), F.col("_at").alias("_prefix"))
    f = F.broadcast(f) if found.count() <= BROADCAST_SOURCES else f
    return rows.join(f, F.col("source").eqNullSafe(F.col("_source")) & (F.shiftright("h", shift) == F.col("_prefix"))).select("source", "size", "h")


def plan(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_repeat: int = 3) -> DataFrame:
    """One row per source: source, source_size, target, copies (that all its documents get), theta (a document
    with a hash up to this gets one copy more). The thresholds are nested: a larger target takes what a smaller takes.

    The histogram of the first 12 bits of the hash finds the bucket where the budget ends, a second one of the next
    12 bits refines only that bucket, and single hash values (a few hundred at 10^10 documents) end it. Nothing is
    sorted but histograms. The document at the end is taken if that comes nearer to the target.
    """
    rows = materialize(docs.select("source", word_count(F.col("text")).alias("size"), text_hash60(F.col("doc_id")).alias("h")), "mix-rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    src = targets(sizes, weights, max_repeat)
    copies = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_repeat))).otherwise(0)
    src = materialize(src.withColumn("copies", copies.cast("long")).withColumn("_budget", F.col("target") - F.col("copies") * F.col("source_size")), "mix-sources")

    none = src.select("source", "_budget", F.lit(0).cast("long").alias("_before"))
    one = materialize(_boundary(rows, F.shiftright("h", HASH_BITS - STEP), none), "mix-first")
    keep = ["source", "_budget", "_before"]
    two = materialize(_boundary(_within(rows, one, HASH_BITS - STEP), F.shiftright("h", HASH_BITS - 2 * STEP), one.select(*keep)), "mix-second")
    last = _boundary(_within(rows, two, HASH_BITS - 2 * STEP), F.col("h"), two.select(*keep))
    nearer = F.col("_before") + F.col("_size") - F.col("_budget") < F.col("_budget") - F.col("_before")
    last = last.select(F.col("source").alias("_source"), F.when(nearer, F.col("_at")).otherwise(F.col("_at") - 1).alias("theta"))
    out = src.join(last, F.col("source").eqNullSafe(F.col("_source")), "left")
    return materialize(out.select("source", "source_size", "target", "copies", F.coalesce("theta", F.lit(1 << HASH_BITS)).alias("theta")), "mix-plan")


def _tagged(docs: DataFrame, weights: Sequence[float], max_repeat: int) -> DataFrame:
    """docs with the mix's columns, named so that they clash with none."""
    chosen = plan(docs, weights, max_repeat)
    if chosen.count() <= BROADCAST_SOURCES:
        chosen = F.broadcast(chosen)
    chosen = chosen.toDF("__mix_source", "__mix_source_size", "__mix_target", "__mix_copies", "__mix_theta")
    out = docs.join(chosen, F.col("source").eqNullSafe(F.col("__mix_source")))
    extra = (text_hash60(F.col("doc_id")) <= F.col("__mix_theta")).cast("long")
    return out.withColumn("__mix_size", word_count(F.col("text"))).withColumn("__mix_repeats", F.col("__mix_copies") + extra)


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_repeat: int = 3) -> DataFrame:
    """docs with size, source_size, target, taken (words) and repeats (copies of the row) added; columns of docs
    with these names are replaced.

    docs has doc_id, source, text; all other columns stay. A null text has size 0. A null source is a source of its
    own, the last. A null doc_id hashes as the empty text. Equal doc_ids share a hash, so they are taken
    together. An empty table gives an empty table. Each source comes within one document (or one group of equal
    doc_ids) of its target.
    """
    new = {"size": F.col("__mix_size"), "source_size": F.col("__mix_source_size"), "target": F.col("__mix_target"), "taken": F.col("__mix_size") * F.col("__mix_repeats"), "repeats": F.col("__mix_repeats")}
    out = _tagged(docs, weights, max_repeat)
    return out.select(*[c for c in docs.columns if c not in new], *[v.alias(k) for k, v in new.items()])


def repeated(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_repeat: int = 3) -> DataFrame:
    """The mix itself: each row of docs as often as the mix takes it, with the columns of docs."""
    times = F.filter(F.array(*[F.lit(i) for i in range(1, max_repeat + 2)]), lambda i: i <= F.col("__mix_repeats"))
    return _tagged(docs, weights, max_repeat).withColumn("__mix_copy", F.explode(times)).select(*docs.columns)


def query(docs: DataFrame) -> DataFrame:
    return mix(docs.select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS ss FROM d GROUP BY source),
w AS (SELECT source, ss, list_extract([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE], CAST((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS BIGINT)) AS w,
             sum(ss) OVER () AS total FROM s),
r AS (SELECT *, CAST(3 * ss AS DOUBLE) / w AS r FROM w),
l AS (SELECT *, CAST(total AS DOUBLE) AS t,
        coalesce(sum(3 * ss) OVER (ORDER BY r, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
        sum(w) OVER (ORDER BY r, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM r),
c AS (SELECT *, r < CAST(total - before AS DOUBLE) / rest AS stopped FROM l),
g AS (SELECT source, ss, CASE WHEN stopped THEN CAST(3 * ss AS DOUBLE)
        ELSE CAST(total - sum(CASE WHEN stopped THEN 3 * ss ELSE 0 END) OVER () AS DOUBLE) * w / sum(CASE WHEN stopped THEN 0.0::DOUBLE ELSE w END) OVER () END AS target FROM c),
k AS (SELECT *, CASE WHEN ss > 0 THEN least(CAST(floor(target / ss) AS BIGINT), 3) ELSE 0 END AS copies FROM g),
b AS (SELECT *, target - copies * ss AS budget FROM k),
x AS (SELECT b.source, d.h, any_value(budget) AS budget, sum(size) AS size FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source GROUP BY b.source, d.h),
y AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h) AS run FROM x),
f AS (SELECT source, arg_min(CASE WHEN run - budget < budget - (run - size) THEN h ELSE h - 1 END, h) AS theta FROM y WHERE run > budget GROUP BY source)
SELECT d.doc_id, d.size, b.ss AS source_size, b.target,
       CAST(d.size * (b.copies + CASE WHEN d.h <= coalesce(f.theta, 1152921504606846976) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN f ON d.source IS NOT DISTINCT FROM f.source
"""
