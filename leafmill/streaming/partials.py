"""Results of a stream as stored partial results, folded when they are read.

Every batch adds what it says alone, in a folder of its own: written bytes follow the batch, not the table, and a
repeated batch replaces itself. ``fold`` joins partial results of any batches in any order to one, so late events
need no state and no watermark. Every ``compact_every`` batches the folded result up to there is written once, and a
reader folds that and the batches behind it. Nothing but the files is remembered, so a restarted stream goes on.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.sources.tables import read_if_there
from leafmill.streaming.events import run_available


@dataclass(frozen=True)
class StoredPartials:
    spark: SparkSession
    path: str
    schema: T.StructType
    fold: Callable[[DataFrame], DataFrame]
    compact_every: int = 50

    def add(self, partial: DataFrame, number: int) -> None:
        """Store the partial result of batch ``number``; batches come in order."""
        partial.select(self.schema.names).write.mode("overwrite").parquet(f"{self.path}/batches/batch={number}")
        if (number + 1) % self.compact_every == 0:
            self.read().write.mode("overwrite").parquet(f"{self.path}/folded/upto={number}")

    def read(self) -> DataFrame:
        """The result of all batches."""
        folded = self._read("folded", "upto")
        upto = folded.agg(F.max("upto")).first()[0]
        rows = self._read("batches", "batch")
        if upto is not None:
            rows = rows.where(F.col("batch") > upto).drop("batch")
            rows = rows.unionByName(folded.where(F.col("upto") == upto).drop("upto"))
        else:
            rows = rows.drop("batch")
        return self.fold(rows).select(self.schema.names)

    def _read(self, name: str, number: str) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField(number, T.LongType())])
        return read_if_there(self.spark, f"{self.path}/{name}", schema)


def maintain(
    stream: DataFrame, partial: Callable[[DataFrame], DataFrame], table: StoredPartials, checkpoint: str | None = None
) -> DataFrame:
    """Add the partial result of everything that has arrived to ``table`` and read it."""
    run_available(stream, "append", lambda batch, number: table.add(partial(batch), number), checkpoint)
    return table.read()


def window_partial(events: DataFrame, size: str, key: str = "user_id") -> DataFrame:
    """Events and their value per key and window, of one batch."""
    return events.groupBy(F.window("ts", size).alias("window"), key).agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value"))


def fold_windows(rows: DataFrame, key: str = "user_id") -> DataFrame:
    return rows.groupBy("window", key).agg(F.sum("events").alias("events"), F.sum("value").alias("value"))


def session_partial(events: DataFrame, gap: str, key: str = "user_id") -> DataFrame:
    """Sessions of one batch alone: (key, start, end, events, first_page, last_page); ``end`` is the last event and the gap."""
    found = events.groupBy(F.session_window("ts", gap).alias("w"), key).agg(
        F.count(F.lit(1)).alias("events"), F.min("page").alias("first_page"), F.max("page").alias("last_page")
    )
    return found.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "first_page", "last_page")


def fold_sessions(rows: DataFrame, key: str = "user_id") -> DataFrame:
    """Sessions that overlap become one, so events that come late join what they lie between.

    Rows of a key are sessions of batches, far fewer than its events.
    """
    ordered = Window.partitionBy(key).orderBy("start", "end")
    before = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    opens: Column = F.coalesce((F.col("start") >= before).cast("int"), F.lit(1))
    numbered = rows.withColumn("_opens", opens).withColumn("_nth", F.sum("_opens").over(ordered))
    return numbered.groupBy(key, "_nth").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("events").alias("events"),
        F.min("first_page").alias("first_page"), F.max("last_page").alias("last_page"),
    ).drop("_nth")
