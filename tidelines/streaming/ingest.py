"""Streaming ingest: revisions arrive out of order and leave as bucket majorities once the watermark passes their bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import TimeFrame


def bucket_counts(revisions: DataFrame, frame: TimeFrame, late: str = "2 days") -> DataFrame:
    """role_id, ts, value, n, latest of each bucket and value. Works on streams (append mode) and on tables alike.

    Buckets are aligned with the frame's start; revisions later than the watermark allows are left out by the stream.
    """
    width = f"{frame.granularity} days"
    epoch = frame.start.toordinal() - 719163
    offset = f"{epoch % frame.granularity} days"
    role = F.concat_ws("||", "key", "property")
    rows = revisions.withWatermark("valid_from", late) if revisions.isStreaming else revisions
    by = rows.groupBy(F.window("valid_from", width, width, offset).alias("w"), role.alias("role_id"), "value").agg(F.count(F.lit(1)).alias("n"), F.max("valid_from").alias("latest"))
    return by.select("role_id", F.to_date("w.start").alias("ts"), "value", "n", "latest")


def run_to_table(stream: DataFrame, path: str, checkpoint: str):
    """Start writing a stream of bucket counts; survives restarts from its checkpoint."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
