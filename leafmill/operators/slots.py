"""Slots for a caller's function: page recognition, transcription, definitions.

Keep the outcome before using it twice, so that the function runs once per row.
A function is made once per task by its factory, so that a model loads once. It
is given a list of rows and returns a list of results. If it fails, its rows are
given to it one by one; a row that fails alone is tried once more and then
skipped with its error on record.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from leafmill.operators.ordering import match
from leafmill.sources.tables import read_if_there

ATTEMPTS = 2
BATCH_ROWS = 64

Row = dict[str, object]
Outcome = tuple[object, str, int, str | None]


def _alone(function: Callable[[list[Row]], list[object]], row: Row) -> Outcome:
    error = None
    for attempt in range(1, ATTEMPTS + 1):
        try:
            return function([row])[0], "ok", attempt, None
        except Exception as failure:  # any failure of a caller's function
            error = f"{type(failure).__name__}: {failure}"
    return None, "skipped", ATTEMPTS, error


def _outcomes(function: Callable[[list[Row]], list[object]], rows: list[Row]) -> list[Outcome]:
    if len(rows) > 1:
        try:
            results = function(rows)
            if len(results) == len(rows):
                return [(value, "ok", 1, None) for value in results]
        except Exception:  # its rows are tried one by one
            pass
    return [_alone(function, row) for row in rows]


def _outcome_schema(rows: DataFrame, keys: Sequence[str], result: T.DataType) -> T.StructType:
    return T.StructType(
        [
            *[rows.schema[k] for k in keys],
            T.StructField("result", result),
            T.StructField("status", T.StringType()),
            T.StructField("attempts", T.IntegerType()),
            T.StructField("error", T.StringType()),
        ]
    )


def run_slot(
    rows: DataFrame,
    keys: Sequence[str],
    factory: Callable[[], Callable[[list[Row]], list[object]]],
    result: T.DataType,
    batch_rows: int = BATCH_ROWS,
    profile: ResourceProfile | None = None,
) -> DataFrame:
    """``keys`` with ``result``, ``status`` (ok or skipped), ``attempts`` and ``error``.

    Every input row gives one output row under its own key, failed ones too. Keys
    are passed through untouched; the function sees at most ``batch_rows`` rows,
    each a dict of plain values with None for null. A list of the wrong length
    counts as a failure of the batch. ``profile`` asks for executors with what the function needs (memory, devices).
    """
    schema = _outcome_schema(rows, keys, result)
    types = [to_arrow_type(result), pa.string(), pa.int32(), pa.string()]
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = factory()
        for whole in batches:
            for start in range(0, whole.num_rows, batch_rows):
                batch = whole.slice(start, batch_rows)
                columns = zip(*_outcomes(function, batch.to_pylist()))
                out = [pa.array(list(c), t) for c, t in zip(columns, types)]
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], *out], names)

    return rows.mapInArrow(run, schema, profile=profile)


def run_stored(
    rows: DataFrame,
    keys: Sequence[str],
    factory: Callable[[], Callable[[list[Row]], list[object]]],
    result: T.DataType,
    path: str,
    waves: int = 16,
    again: bool = False,
    **options,
) -> DataFrame:
    """Outcomes of ``run_slot`` kept below ``path``: the function is called only for rows that have none there.

    ``keys`` tell the rows apart. Rows are dealt to ``waves`` by a hash of their keys, and each wave is a write of its
    own, so a job that fails or is restarted loses at most the wave it was in; a lost executor costs its unfinished tasks.
    With ``again``, rows that were skipped are tried anew, and the newest outcome of a row counts.
    """
    spark = rows.sparkSession
    fields = _outcome_schema(rows, keys, result).fields
    stored = T.StructType([*fields, T.StructField("wave", T.IntegerType()), T.StructField("run", T.LongType())])
    newest = read_if_there(spark, path, stored).agg(F.max("run")).first()[0]
    number = 0 if newest is None else newest + 1
    wave_of = F.pmod(F.xxhash64(*keys), F.lit(waves))
    for wave in range(waves):
        held = read_if_there(spark, path, stored).where(F.col("wave") == wave)
        if again:
            held = held.where("status = 'ok'")
        todo = match(rows.where(wave_of == wave), held.select(*keys), keys, "left_anti")
        outcomes = run_slot(todo, keys, factory, result, **options)
        outcomes.write.mode("overwrite").parquet(f"{path}/wave={wave}/run={number}")
    kept = spark.read.schema(stored).parquet(path)
    if not again and number == 0:
        return kept.drop("wave", "run")
    last = kept.groupBy(*keys).agg(F.max("run").alias("run"))
    return match(kept, last, [*keys, "run"], "left_semi").drop("wave", "run")


def split_outcomes(outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    return outcomes.filter("status = 'ok'"), outcomes.filter("status = 'skipped'")


REGION = T.StructType(
    [
        T.StructField("ix", T.IntegerType()),
        T.StructField("x1", T.DoubleType()),
        T.StructField("y1", T.DoubleType()),
        T.StructField("x2", T.DoubleType()),
        T.StructField("y2", T.DoubleType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("is_vertical", T.BooleanType()),
        T.StructField("direction", T.IntegerType()),
        T.StructField("text", T.StringType()),
    ]
)


def recognise_pages(
    pages: DataFrame, keys: Sequence[str], engine: Callable[[], Callable[[list[Row]], list[list[Row]]]]
) -> DataFrame:
    """Regions an engine finds on each page; skipped pages keep a row without region."""
    outcomes = run_slot(pages, keys, engine, T.ArrayType(REGION))
    found = outcomes.select(*keys, "status", "attempts", F.explode_outer("result").alias("r"))
    return found.select(*keys, "status", "attempts", "r.*")


def transcribe(
    features: DataFrame, engine: Callable[[], Callable[[list[Row]], list[str]]], block_frames: int = 3_000
) -> DataFrame:
    """Texts an engine gives for blocks of log-mel frames.

    ``features`` has (signal_id, frame, mel, value). The engine sees rows with
    ``features``: frames in order, each a list of mel values. A block has at most
    ``block_frames`` frames (30 seconds at the usual hop), so a long signal is
    many rows.
    """
    block = F.floor(F.col("frame") / block_frames).alias("block")
    frames = features.groupBy("signal_id", block, "frame").agg(
        F.sort_array(F.collect_list(F.struct("mel", "value"))).alias("m")
    )
    blocks = frames.groupBy("signal_id", "block").agg(
        F.sort_array(F.collect_list(F.struct("frame", F.col("m.value").alias("v")))).alias("f")
    )
    rows = blocks.select("signal_id", "block", F.col("f.v").alias("features"))
    return run_slot(rows, ["signal_id", "block"], engine, T.StringType())


def define(
    words: DataFrame, keys: Sequence[str], engine: Callable[[], Callable[[list[Row]], list[str]]]
) -> DataFrame:
    """Definitions an engine gives for rows with ``word`` and ``context``, with retry and skip."""
    outcomes = run_slot(words, keys, engine, T.StringType())
    return outcomes.withColumnRenamed("result", "definition")
