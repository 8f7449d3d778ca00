"""Times as the catalog stores them: seconds since the epoch, or text in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_seconds(time: Column | None = None) -> Column:
    """Whole seconds of an instant, or of now."""
    return F.unix_timestamp(F.current_timestamp() if time is None else time)


def stamp(seconds: Column | None = None) -> Column:
    """Text of an epoch time, or of now, in the session time zone (UTC)."""
    time = F.current_timestamp() if seconds is None else F.timestamp_seconds(seconds)
    return F.date_format(time, "yyyy-MM-dd HH:mm:ss")
