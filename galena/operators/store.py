"""Writes to and reads from a store, as DataFrame transformations that leave their inputs alone.

Vectors have slot, id, embedding, norm, live; metadata has id and metadata (a map of tagged values). A rejected batch raises
before anything is written. Numbers are dealt out without gathering rows in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..errors import DuplicateIdError, InvalidArgumentError, InvalidVectorError, NotFoundError
from ..functions import metadata as M
from ..functions.metrics import fault, is_finite, norm, normalize
from ..plans.options import CollectionConfig

VECTORS = T.StructType([
    T.StructField("slot", T.LongType()), T.StructField("id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("norm", T.DoubleType()), T.StructField("live", T.BooleanType()),
])
METADATA = T.StructType([T.StructField("id", T.LongType()), T.StructField("metadata", M.METADATA)])
#: Numbers that one group of numbered() holds.
RANGE = 100_000


def numbered(df: DataFrame, order: str, name: str, start: int | Column = 0) -> DataFrame:
    """df with a dense number by a column of distinct longs, from start. Ranges of the column are counted, the counts
    are summed over (one row per RANGE values), and each range is numbered on its own."""
    rows = df.withColumn("_range", F.floor(F.col(order) / RANGE))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("_range").agg(F.count("*").alias("_n")).select(F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1
    out = rows.withColumn("_own", own).join(sums, F.col("_range") == F.col("_r"))
    first = F.lit(start) if isinstance(start, int) else start
    return out.withColumn(name, (first + F.col("_before") + F.col("_own")).cast("long")).drop("_range", "_own", "_r", "_before")


def validate(batch: DataFrame, config: CollectionConfig) -> None:
    """Raise on the first fault among the vectors of a batch (ordinal, id, embedding, ...); one aggregate finds it."""
    bad = batch.select("ordinal", "id", fault(F.col("embedding"), config.dimension).alias("why"), (F.col("id") < 0).alias("negative"))
    row = bad.where("why IS NOT NULL OR negative").agg(F.min_by(F.struct("ordinal", "id", "why"), "ordinal").alias("x"), F.count("*").alias("n")).first()
    if row["n"]:
        x = row["x"]
        raise InvalidVectorError(f"{row['n']} of the batch cannot be stored; the first is row {x['ordinal']} (id {x['id']}): {x['why'] or 'the id is negative or beyond 2**63'}")


def with_auto_ids(batch: DataFrame, next_id: int) -> DataFrame:
    """Rows without an id get the next ones in the order of ordinal, above all ids ever used and those of the batch."""
    top = batch.agg(F.max("id")).first()[0]
    start = max(next_id, (top + 1) if top is not None else 0)
    free = numbered(batch.where("id IS NULL").drop("id"), "ordinal", "id", start)
    return batch.where("id IS NOT NULL").unionByName(free.select(*batch.columns))


def check_duplicates(batch: DataFrame, vectors: DataFrame) -> None:
    """Raise if an id is twice in a batch or is live already."""
    twice = batch.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").agg(F.min("id"), F.count("*")).first()
    if twice[1]:
        raise DuplicateIdError(f"{twice[1]} ids are given more than once in the batch, the first is {twice[0]}")
    held = batch.select("id").join(vectors.where("live").select("id"), "id", "left_semi").agg(F.min("id"), F.count("*")).first()
    if held[1]:
        raise DuplicateIdError(f"{held[1]} ids of the batch exist already, the first is {held[0]}")


def new_rows(batch: DataFrame, config: CollectionConfig, next_slot: int) -> DataFrame:
    """Rows of VECTORS for a batch (ordinal, id, embedding): slots in the order of ordinal, norms of what was given."""
    v = F.col("embedding")
    kept = normalize(v) if config.normalize else v
    rows = numbered(batch.select("ordinal", "id", kept.cast("array<float>").alias("embedding")), "ordinal", "slot", next_slot)
    return rows.select("slot", "id", "embedding", norm(F.col("embedding")).alias("norm"), F.lit(True).alias("live"))


def upsert(vectors: DataFrame, batch: DataFrame, config: CollectionConfig, next_slot: int) -> DataFrame:
    """vectors with the batch (ordinal, id, embedding): live ids keep their slots, others are appended."""
    live = vectors.where("live").select(F.col("id").alias("_id"))
    fresh = new_rows(batch.join(live, F.col("id") == F.col("_id"), "left_anti"), config, next_slot)
    v = F.col("_new")
    kept = (normalize(v) if config.normalize else v).cast("array<float>")
    given = batch.select(F.col("id").alias("_id"), F.col("embedding").alias("_new"))
    old = vectors.join(given, (F.col("id") == F.col("_id")) & F.col("live"), "left")
    changed = F.col("_id").isNotNull()
    old = old.withColumn("embedding", F.when(changed, kept).otherwise(F.col("embedding")))
    old = old.withColumn("norm", F.when(changed, norm(F.col("embedding"))).otherwise(F.col("norm")))
    return old.select(*fresh.columns).unionByName(fresh)


def replace_metadata(metadata: DataFrame, given: DataFrame) -> DataFrame:
    """The maps of given (id, metadata) in place of those of their ids; an empty map leaves no row."""
    rest = metadata.join(given.select(F.col("id").alias("_id")), F.col("id") == F.col("_id"), "left_anti")
    return rest.unionByName(given.where(F.size("metadata") > 0).select("id", "metadata"))


def merge_metadata(metadata: DataFrame, given: DataFrame) -> DataFrame:
    """Entries of given win over those that are there; other keys stay."""
    new = given.select(F.col("id").alias("_id"), F.col("metadata").alias("_new"))
    both = metadata.join(new, F.col("id") == F.col("_id"), "full_outer")
    return both.select(F.coalesce("id", "_id").alias("id"), M.merge(F.col("metadata"), F.col("_new")).alias("metadata"))


def remove_key(metadata: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    if not key:
        raise InvalidArgumentError("the metadata key is empty")
    there = metadata.join(ids.select(F.col("id").alias("_id")), F.col("id") == F.col("_id"), "left")
    out = there.withColumn("metadata", F.when(F.col("_id").isNotNull(), M.without(F.col("metadata"), key)).otherwise(F.col("metadata")))
    return out.where(F.size("metadata") > 0).select("id", "metadata")


def remove(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """vectors in which the live rows of ids are tombstones, which keep their slots."""
    gone = ids.select(F.col("id").alias("_id")).distinct()
    out = vectors.join(gone, (F.col("id") == F.col("_id")) & F.col("live"), "left")
    return out.withColumn("live", F.col("live") & F.col("_id").isNull()).drop("_id")


def remove_metadata(metadata: DataFrame, ids: DataFrame) -> DataFrame:
    return metadata.join(ids.select(F.col("id").alias("_id")), F.col("id") == F.col("_id"), "left_anti")


def require(vectors: DataFrame, ids: DataFrame) -> None:
    """Raise unless all ids are live."""
    missing = ids.select("id").join(vectors.where("live").select("id"), "id", "left_anti").agg(F.min("id"), F.count("*")).first()
    if missing[1]:
        raise NotFoundError(f"{missing[1]} ids do not exist, the first is {missing[0]}")


def compact(vectors: DataFrame) -> DataFrame:
    """Live rows alone, with dense slots in the order of their old ones; ids stay."""
    rows = numbered(vectors.where("live").withColumnRenamed("slot", "_slot"), "_slot", "slot")
    return rows.select("slot", "id", "embedding", "norm", "live")


def all_ids(vectors: DataFrame) -> DataFrame:
    return vectors.where("live").select("id").orderBy("id")


def get(vectors: DataFrame, metadata: DataFrame, ids: Sequence[int]) -> DataFrame:
    """id, embedding (as stored) and metadata of live ids."""
    found = vectors.where(F.col("live") & F.col("id").isin(list(ids))).select("id", "embedding")
    return found.join(metadata.where(F.col("id").isin(list(ids))), "id", "left")


def contains(vectors: DataFrame, id: int) -> bool:
    return not vectors.where(F.col("live") & (F.col("id") == id)).isEmpty()


def matching(metadata: DataFrame, filter) -> DataFrame:
    """Ids whose metadata matches, ascending; without conditions all ids that have metadata."""
    return metadata.where(filter.compile(F.col("metadata"))).select("id").orderBy("id")


def filter_ids(vectors: DataFrame, metadata: DataFrame, filter) -> DataFrame:
    """Live ids whose metadata matches, ascending."""
    live = vectors.where("live").select("id")
    return metadata.where(filter.compile(F.col("metadata"))).select("id").join(live, "id", "left_semi").orderBy("id")


def orphans(vectors: DataFrame, metadata: DataFrame) -> DataFrame:
    """Ids with metadata that are not live, ascending."""
    return metadata.select("id").join(vectors.where("live").select("id"), "id", "left_anti").distinct().orderBy("id")


def remove_orphans(vectors: DataFrame, metadata: DataFrame) -> DataFrame:
    return metadata.join(vectors.where("live").select("id"), "id", "left_semi")


def metadata_keys(metadata: DataFrame) -> DataFrame:
    return metadata.select(F.explode(F.map_keys("metadata")).alias("key")).distinct().orderBy("key")


def stats(vectors: DataFrame, metadata: DataFrame) -> DataFrame:
    """One row: live_vectors, slots, tombstones, tombstone_ratio, vector_bytes, metadata_vectors, metadata_rows, metadata_keys."""
    v = vectors.agg(
        F.coalesce(F.sum(F.col("live").cast("long")), F.lit(0)).alias("live_vectors"),
        F.count("*").alias("slots"),
        F.coalesce(F.sum((~F.col("live")).cast("long")), F.lit(0)).alias("tombstones"),
        F.coalesce(F.avg((~F.col("live")).cast("double")), F.lit(0.0)).alias("tombstone_ratio"),
        F.coalesce(F.sum(F.size("embedding").cast("long") * 4), F.lit(0)).alias("vector_bytes"),
    )
    m = metadata.agg(F.count_distinct("id").alias("metadata_vectors"), F.coalesce(F.sum(F.size("metadata").cast("long")), F.lit(0)).alias("metadata_rows"))
    k = metadata.select(F.explode(F.map_keys("metadata")).alias("key")).agg(F.count_distinct("key").alias("metadata_keys"))
    return v.crossJoin(m).crossJoin(k)  # single rows


def check(vectors: DataFrame, metadata: DataFrame, dimension: int, deep: bool = False) -> DataFrame:
    """severity, message of all that is wrong with the two tables; no row if nothing is."""
    orphaned = orphans(vectors, metadata).agg(F.count("*").alias("n"), F.min("id").alias("first"))
    warn_orphans = orphaned.where("n > 0").select(F.lit("warning").alias("severity"), F.concat("n", F.lit(" ids have metadata but no vector (first: "), "first", F.lit("); compact removes them")).alias("message"))
    slots = vectors.agg(F.count("*").alias("n"), F.coalesce(F.sum((~F.col("live")).cast("long")), F.lit(0)).alias("dead"))
    half = slots.where("n > 100 AND dead > 0.5 * n").select(F.lit("warning").alias("severity"), F.concat(F.lit("more than half the slots are tombstones ("), "dead", F.lit(" of "), "n", F.lit("); compact reclaims them")).alias("message"))
    wrong = vectors.where(F.size("embedding") != dimension).agg(F.count("*").alias("n"), F.min("slot").alias("first"))
    wrong = wrong.where("n > 0").select(F.lit("error").alias("severity"), F.concat("n", F.lit(f" vectors do not have dimension {dimension} (first slot: "), "first", F.lit(")")).alias("message"))
    twice = vectors.groupBy("slot").agg(F.count("*").alias("c")).where("c > 1").agg(F.count("*").alias("n"), F.min("slot").alias("first"))
    twice = twice.where("n > 0").select(F.lit("error").alias("severity"), F.concat("n", F.lit(" slots are used twice (first: "), "first", F.lit(")")).alias("message"))
    out = wrong.union(twice).union(warn_orphans).union(half)
    if deep:
        bad = vectors.where(~is_finite(F.col("embedding"))).agg(F.min(F.struct("slot", "id")).alias("x"))
        bad = bad.where("x IS NOT NULL").select(F.lit("error").alias("severity"), F.concat(F.lit("slot "), "x.slot", F.lit(" (id "), "x.id", F.lit(") contains a non-finite component")).alias("message"))
        out = out.union(bad)
    return out
