"""Event counts per time window, and reading sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_counts(
    events: DataFrame, size: str, slide: str | None = None, delay: str = "1 hour",
    key: str = "user_id", deduplicate: bool = True,
) -> DataFrame:
    """Events and their value per key and window; late repeats are dropped once."""
    marked = events.withWatermark("ts", delay)
    if deduplicate:
        marked = marked.dropDuplicatesWithinWatermark(["event_id"])
    return marked.groupBy(F.window("ts", size, slide), key).agg(
        F.count(F.lit(1)).alias("events"), F.sum("value").alias("value")
    )


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour", key: str = "user_id") -> DataFrame:
    """Reading sessions per key: events no further apart than ``gap``.

    Set ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition`` so
    that a busy key's events merge to sessions before they are shuffled.
    """
    return events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), key).agg(
        F.count(F.lit(1)).alias("events"),
        F.min("page").alias("first_page"),
        F.max("page").alias("last_page"),
    )
