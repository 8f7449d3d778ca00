"""Opening a catalog: one Parquet folder per table, each with its fixed schema."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from leafmill.schemas import TABLES


def open_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")


def open_catalog(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Every table of a catalog, read with its schema (nothing is inferred)."""
    return {name: open_table(spark, root, name) for name in TABLES}


def read_if_there(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet folder, or no rows if nothing was written there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def memory_catalog(spark: SparkSession, rows: dict[str, list[tuple]] | None = None) -> dict[str, DataFrame]:
    """A catalog of small in-memory tables, also registered as views, for tests."""
    given = rows or {}
    catalog = {n: spark.createDataFrame(given.get(n, []), s) for n, s in TABLES.items()}
    for name, df in catalog.items():
        df.createOrReplaceTempView(name)
    return catalog


def spread(df: DataFrame) -> DataFrame:
    """The rows of a scan dealt out to all cores if its files give fewer splits.

    For scans followed by costly work per row. Large inputs have more splits than
    there are cores and are left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def sample_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the generated sample tables, a single Parquet file or folder each."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
