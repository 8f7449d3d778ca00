"""Live conversion progress from page events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.operators.merge import fold_latest
from leafmill.session import fresh_path
from leafmill.streaming.events import run_available
from leafmill.streaming.partials import StoredPartials


def live_progress(events: DataFrame) -> DataFrame:
    """Per book: furthest page, newest status and its time.

    ``events`` has book_id, page, status, ts, event_id. Largest values are the
    same however often an event arrives, so repeats need no removal. Keep it in
    update mode: only changed books leave the stream.
    """
    newest = F.struct("ts", "event_id")
    return events.groupBy("book_id").agg(
        F.max("page").alias("last_processed_page"),
        F.max_by("status", newest).alias("status"),
        F.max(newest).alias("newest"),
    )


def maintain_progress(
    events: DataFrame, path: str | None = None, checkpoint: str | None = None, compact_every: int = 50
) -> DataFrame:
    """Progress of everything that has arrived: each batch stores its changed books, readers fold them.

    A repeated batch replaces itself, and a restarted stream goes on where it was.
    """
    spark = events.sparkSession
    changed = live_progress(events)
    fold = lambda rows: fold_latest(rows, "book_id", ["newest", "last_processed_page"])
    table = StoredPartials(spark, path or fresh_path(spark, "progress"), changed.schema, fold, compact_every)
    run_available(changed, "update", table.add, checkpoint)
    return table.read()
