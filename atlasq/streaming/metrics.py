"""The dependency and latency rollups over streams. An extension: the batch operators define the results.

Windows are event-time windows; rows later than the watermark are left out, which batch runs do not do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_latency(events: DataFrame, keys: list[str], width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window, keys, calls, known_calls, success_calls, duration_us) in append mode. ts must be a timestamp with zone."""
    rows = events.withWatermark("ts", late)
    out = rows.groupBy(F.window("ts", width).alias("window"), *keys).agg(
        F.sum("calls").alias("calls"), F.sum(F.col("known").cast("long")).alias("known_calls"), F.sum(F.col("success").cast("long")).alias("success_calls"), F.sum("duration_us").alias("duration_us"), F.max("duration_us").alias("max_us")
    )
    return out.select(F.col("window.start").alias("window_start"), *keys, "calls", "known_calls", "success_calls", "duration_us", "max_us")


def windowed_dependencies(buckets: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    rows = buckets.withWatermark("ts", late)
    failed = F.sum(F.when(F.col("outcome") == "failure", F.col("calls")).otherwise(0))
    out = rows.groupBy(F.window("ts", width).alias("window"), "source", "target", "target_type").agg(F.sum("calls").alias("calls"), failed.alias("failure_calls"), F.sum("duration_us").alias("duration_us"))
    return out.select(F.col("window.start").alias("window_start"), "source", "target", "target_type", "calls", "failure_calls", "duration_us")


def sink_parquet(stream: DataFrame, path: str, checkpoint: str):
    """Exactly once into Parquet; ends when all input that is there has been read."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
