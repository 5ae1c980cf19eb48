"""Continuous ingest: each micro-batch of a stream is upserted as one snapshot. The reference has no streams; this is an addition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..collection import Collection


def latest(batch: DataFrame) -> DataFrame:
    """The last row of each id, by ordinal where there is one."""
    order = F.col("ordinal") if "ordinal" in batch.columns else F.monotonically_increasing_id()
    rows = batch.withColumn("_order", order)
    whole = F.struct(*[F.col(c) for c in batch.columns])
    return rows.groupBy("id").agg(F.max_by(whole, "_order").alias("_row")).select("_row.*")


def ingest(stream: DataFrame, collection: Collection, checkpoint: str, **trigger) -> StreamingQuery:
    """Upsert a stream (id, embedding and, if there is one, metadata). A batch that is run again after a failure gives the
    same state, since upserts of the same rows do."""

    def upsert(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            collection.upsert(latest(batch))

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
