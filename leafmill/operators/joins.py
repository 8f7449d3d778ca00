"""Broadcasts behind a check of the size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL_ROWS = 200_000


def broadcast_if_small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, else as it is.

    For tables that are small by nature, such as dictionaries, whose size Spark
    cannot see; keep a computed one first, as it is read twice. A larger one is joined by shuffles, where AQE splits busy keys.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
