"""Streams: files that arrive are parsed and stored as in batch, and events are counted by windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import IDS, KnowledgeStore


def stream_table(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def upsert_stream(rows: DataFrame, store: KnowledgeStore, table: str, checkpoint: str, keys: tuple[str, ...] | None = None) -> StreamingQuery:
    """Takes in all that is there, each micro-batch once.

    Rows replace those with the same id of that table, or, where they have no such
    column, equal rows; so a source's rows may come in any number of batches. With
    ``keys`` a batch holds all rows of each key that it has, and replaces them.
    Repeated rows of a batch count once. The store notes each batch's number beside its
    rows, so one that runs again after a failure changes nothing.
    """

    def take(batch: DataFrame, number: int) -> None:
        own = IDS.get(table)
        own = own if own in batch.columns else None
        once = batch.dropDuplicates([own] if own else None)
        on = keys or ((own,) if own else tuple(batch.columns))
        store.upsert(table, once, on, together=keys is None, batch=(checkpoint, number))

    return rows.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) of events (ts, event_type, value); works on streams and tables alike."""
    at = F.window("ts", window, slide) if slide else F.window("ts", window)
    rows = events.withWatermark("ts", late).groupBy(at.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n): events of a user with less than ``gap`` between them."""
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
