"""JSON documents as typed rows and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.schemas import APP_STATE


def to_document(df: DataFrame) -> Column:
    """The whole row as one JSON object, nulls included."""
    return F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})


def from_document(df: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """Adds ``document`` (typed, null where the JSON is malformed) and ``reject_reason``."""
    strict = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    parsed = F.from_json(
        F.col(column), strict, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    )
    good = F.col("_p").isNotNull() & F.col("_p._corrupt").isNull()
    typed = F.struct(*[F.col(f"_p.{f.name}").alias(f.name) for f in schema.fields])
    return (
        df.withColumn("_p", parsed)
        .withColumn("document", F.when(good, typed))
        .withColumn("reject_reason", F.when(~good, "malformed document"))
        .drop("_p")
    )


def last_states(log: DataFrame, user: str, column: str) -> DataFrame:
    """The newest well-formed application state of each user from JSON documents."""
    parsed = from_document(log, column, APP_STATE).filter("reject_reason is null")
    states = parsed.select(user, "document.*")
    newest = F.struct("timestamp", "current_route", "scroll_position")
    return states.groupBy(user).agg(F.max(newest).alias("s")).select(user, "s.*")
