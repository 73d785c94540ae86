"""Extension: the append-only observation log as a stream (the batch contract has no streams)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_observations(stream: DataFrame, key: str = "observation_id", time: str = "observed_at", late: str = "7 days") -> DataFrame:
    """Each observation once; its id is remembered for ``late``."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, *by: str, time: str = "observed_at", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Observations in each time window and group; windows close when the watermark passes."""
    counted = stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")
