"""Ledger views kept up to date from a stream of chapter events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scrollwork.sources.sinks import write_events


def read(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """Events of parquet files as they arrive. `ts` without zone is taken as UTC, since watermarks need an instant."""
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, size: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Counts and sums per event type in tumbling or sliding windows; events later than `late` are left out."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    g = events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each user, closed by a gap."""
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def apply(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write arriving events (book, chapter, ...) chapter by chapter. A chapter that comes again replaces
    its earlier rows, so that a batch repeated after a failure changes nothing."""
    return events.writeStream.foreachBatch(lambda batch, _: write_events(batch, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
