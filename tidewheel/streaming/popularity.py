"""An addition to the batch plans: popularity and latest events kept up to date over a stream of interactions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_popularity(events: DataFrame, window: str = "1 day", late: str = "1 hour", key: str = "event_type") -> DataFrame:
    """Events by ``key`` in tumbling windows of ``ts``; rows later than ``late`` are left out and old windows leave the state."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", window), key).agg(F.count("*").alias("cnt"))
    return w.select(F.col("window.start").alias("start"), key, "cnt")


def latest_events(events: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """The last event of every user in each window."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", window), "user_id").agg(F.max_by("event_type", "ts").alias("last_type"), F.max("ts").alias("last_ts"))
    return w.select(F.col("window.start").alias("start"), "user_id", "last_type", "last_ts")
