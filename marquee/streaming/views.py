"""Extension: the member activity as a stream. The batch engine computes the same counts from snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def deduplicated(views: DataFrame, at: str = "ts", late: str = "1 hour") -> DataFrame:
    """One view of a member, event and hour; state is dropped behind the watermark."""
    hour = views.withColumn("hour", F.date_trunc("hour", F.col(at)))
    return hour.withWatermark(at, late).dropDuplicatesWithinWatermark(["user_id", "event_id", "hour"])


def windowed(views: DataFrame, at: str = "ts", size: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts by event type in tumbling or sliding windows."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return views.withWatermark(at, late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(views: DataFrame, at: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return views.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def into(stream: DataFrame, apply: Callable[[DataFrame], None], checkpoint: str) -> DataStreamWriter:
    """Micro-batches through a snapshot transform such as the upsert; apply must be idempotent for a batch that comes again."""
    return stream.writeStream.foreachBatch(lambda batch, _id: apply(batch)).option("checkpointLocation", checkpoint)
