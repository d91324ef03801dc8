"""Streaming inputs: event counts in tumbling windows with a watermark, the samples of a chain of networks."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, length: str = "7 days", late: str = "1 day", ts: str = "ts") -> DataFrame:
    """Counts by window, user and event type; events later than the watermark are left out of a stream."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return e.groupBy(F.window(ts, length).alias("w"), "user_id", "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "user_id", "event_type", "n")
