"""Event files as a stream, and results of a stream as a stored table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from leafmill.session import fresh_path
from leafmill.sources.tables import read_if_there

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def event_stream(spark: SparkSession, folder: str, files_per_batch: int = 1_000) -> DataFrame:
    """Events as they arrive as Parquet files, with ``ts`` as an instant.

    Watermarks need instants; the session time zone should be UTC.
    """
    raw = (
        spark.readStream.schema(EVENT_SCHEMA)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(f"{folder}/events.parquet*")
    )
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def run_available(
    stream: DataFrame,
    mode: str,
    on_batch: Callable[[DataFrame, int], None],
    checkpoint: str | None = None,
) -> StreamingQuery:
    """Process what has arrived, then stop; restartable from ``checkpoint``."""
    place = checkpoint or fresh_path(stream.sparkSession, "stream")
    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(on_batch)
        .option("checkpointLocation", place)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def stored_result(stream: DataFrame, mode: str, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Run a stream over what has arrived and read its result back from files.

    In append mode each batch is its own folder, so a repeated batch overwrites itself, and all count. In complete mode
    a batch holds the whole result and the newest counts. The folders say which batches there are, so with ``path`` and
    ``checkpoint`` of an earlier run the result goes on from there, also if nothing new has arrived.
    """
    spark = stream.sparkSession
    target = path or fresh_path(spark, "result")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    run_available(stream, mode, write, checkpoint)
    stored = read_if_there(spark, target, T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())]))
    if mode == "complete":
        newest = stored.select("batch").agg(F.max("batch")).first()[0]
        if newest is not None:
            stored = stored.where(F.col("batch") == newest)
    return stored.drop("batch")
