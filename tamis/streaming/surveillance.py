"""Continuous surveillance as streams: arriving listed rows, webhooks and alerts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

BURST = 10


def inbox(spark: SparkSession, path: str, schema, archive: str | None = None) -> DataFrame:
    """Parquet files as they arrive in a folder, each taken once; taken files go to archive. Times get the session's zone, as watermarks need one."""
    reader = spark.readStream.schema(schema)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    rows = reader.parquet(path)
    return rows.select(*(F.col(c).cast("timestamp").alias(c) if kind == "timestamp_ntz" else F.col(c) for c, kind in rows.dtypes))


def idempotent(calls: DataFrame, key: str, at: str, keep: str = "90 days") -> DataFrame:
    """Calls whose idempotency key was not seen within the retention; state ends with the watermark."""
    return calls.withWatermark(at, keep).dropDuplicatesWithinWatermark([key])


def endpoint_windows(calls: DataFrame, at: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Extension: calls by endpoint and tumbling window."""
    return calls.withWatermark(at, late).groupBy(F.window(at, width), "event_type").agg(F.count("*").alias("calls"), F.sum("value").alias("value"))


def caller_sessions(calls: DataFrame, at: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Extension: sessions of callers, ended by a pause."""
    return calls.withWatermark(at, late).groupBy(F.session_window(at, gap), "user_id").agg(F.count("*").alias("calls"))


def rescreened(changes: DataFrame, clients: DataFrame, candidates: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Pairs of arriving listed rows (entity_id, keys) with the standing client book: a stream joined with a table."""
    return candidates(clients, changes)


def merging(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """A writer that merges each batch into its table; a batch that is repeated after a failure has the same number."""
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def with_burst_cap(events: DataFrame, kind: str = "kind", most: int = BURST) -> DataFrame:
    """Notifications of a batch; more than `most` of one kind become one that tells how many."""
    counted = events.groupBy(kind).agg(F.count("*").alias("n"))
    marked = events.join(counted, kind)
    single = marked.where(F.col("n") <= most).select(kind, "message", F.lit(1).cast("bigint").alias("events"))
    burst = counted.where(F.col("n") > most).select(kind, F.concat(F.col("n").cast("string"), F.lit(" events")).alias("message"), F.col("n").alias("events"))
    return single.unionByName(burst)
