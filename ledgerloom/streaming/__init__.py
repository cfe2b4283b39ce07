"""Streams of records and events: windows that tolerate late rows, and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import scratch


def file_stream(spark: SparkSession, path: str, glob: str, like: DataFrame) -> DataFrame:
    """A stream of the parquet files of a folder, with the schema of a table like them."""
    return spark.readStream.schema(like.schema).option("pathGlobFilter", glob).parquet(path)


def windowed(events: DataFrame, at: str, keys: list[str], value: str, size: str, late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums per window and key; on a stream, rows later than ``late`` are left out."""
    e = events.withColumn("_at", F.col(at).cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark("_at", late)
    w = F.window("_at", size, slide) if slide else F.window("_at", size)
    g = e.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("events"), F.round(F.sum(value), 4).alias("total"))
    return g.select(F.col("w.start").alias("window_start"), *keys, "events", "total")


def sessions(events: DataFrame, at: str, user: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user, start, end, events): runs of a user's events with no gap of ``gap`` or more."""
    e = events.withColumn("_at", F.col(at).cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark("_at", late)
    g = e.groupBy(F.session_window("_at", gap).alias("w"), user).agg(F.count("*").alias("events"))
    return g.select(user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all there is, and give the rows it made.

    Rows go to a table in the shared folder, never to the driver: those of finished windows as they finish; with mode
    "complete", the whole result of each batch in place of the last.
    """
    spark = stream.sparkSession
    path, progress = scratch(spark, name), scratch(spark, f"{name}-progress")
    w = stream.writeStream.option("checkpointLocation", progress).trigger(availableNow=True)
    if mode == "complete":
        w = w.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path))
    else:
        w = w.outputMode("append").format("parquet").option("path", path)
    w.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
