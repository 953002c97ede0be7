"""Incremental refresh: an addition of this engine, around the partition-replacing write.

New symbol files arrive in a folder; each micro-batch replaces the entries it brings. A
batch that is run again after a failure writes the same partitions, so replays are safe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from symbolarium.operators.index_store import IndexStore
from symbolarium.operators.store import ENTRY


def stale(current: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Entries to index again: those whose ``fingerprint`` is not stored, or null."""
    fresh = stored.where("fingerprint IS NOT NULL").select(*keys, "fingerprint")
    return current.join(fresh, [*keys, "fingerprint"], "left_anti")


def refresh_stream(spark: SparkSession, incoming: str, schema: str, store: IndexStore, checkpoint: str) -> StreamingQuery:
    """Start a query that takes what is there and what comes in ``incoming`` (Parquet files of
    ``schema`` with the entry columns) and ends when all available is indexed."""

    def write(batch: DataFrame, batch_id: int) -> None:
        # Seconds of the clock, as every other writer of the store; a replayed batch is newer.
        meta = batch.select(*ENTRY).distinct().withColumn("indexed_at", F.unix_timestamp(F.current_timestamp()))
        store.replace(batch, meta)

    stream = spark.readStream.schema(schema).parquet(incoming)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
