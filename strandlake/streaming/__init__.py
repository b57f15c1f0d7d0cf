"""Running aggregates over streams of modifications."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_rates(stream: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window, gene, pos, n): modifications by position and event-time window, from a stream of (gene, read_id, pos, ts);
    rows later than the watermark are dropped, as streaming aggregates do."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", window), "gene", "pos").agg(F.count("*").alias("n"))
