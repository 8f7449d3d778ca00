"""Constraint checks as tables of violations, and inserts that respect them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unique_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def check_unique(target: DataFrame, batch: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Batch rows with ``reject_reason``: null if the row may be inserted.

    The first row of a key (by ``seq``) wins unless the target has the key. The
    winner is one aggregate row per key, so repeats combine before the shuffle
    and only the batch side of the join can be skewed, which AQE splits.
    """
    first = batch.groupBy(*keys).agg(F.min(seq).alias("_first"))
    taken = target.select(*keys).distinct().withColumn("_taken", F.lit(True))
    verdict = first.join(taken, list(keys), "left")
    reason = F.when(F.col("_taken"), "key exists").when(
        F.col(seq) != F.col("_first"), "repeated in batch"
    )
    return (
        batch.join(verdict, list(keys), "left")
        .withColumn("reject_reason", reason)
        .drop("_first", "_taken")
    )


def foreign_key_orphans(
    children: Sequence[tuple[str, DataFrame, str, str]], parents: DataFrame, parent_key: str
) -> DataFrame:
    """Child rows that name no parent, as ``(child, row_id, parent_id)``.

    ``children`` holds (name, rows, row id column, foreign key column). A null
    foreign key names nothing and is no violation.
    """
    known = parents.select(F.col(parent_key).cast("string").alias("parent_id")).distinct()
    found: DataFrame | None = None
    for name, rows, row_id, key in children:
        named = rows.select(
            F.lit(name).alias("child"),
            F.col(row_id).cast("string").alias("row_id"),
            F.col(key).cast("string").alias("parent_id"),
        ).filter("parent_id is not null")
        orphans = named.join(known, "parent_id", "left_anti").select("child", "row_id", "parent_id")
        found = orphans if found is None else found.unionByName(orphans)
    if found is None:
        raise ValueError("no child tables given")
    return found


def first_broken_rule(rules: Sequence[tuple[str, Column]]) -> Column:
    """Name of the first rule that does not hold (null counts as broken)."""
    checks = [F.when(F.coalesce(~ok, F.lit(True)), F.lit(name)) for name, ok in rules]
    return F.coalesce(*checks)


def domain_violations(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    return df.withColumn("reject_reason", first_broken_rule(rules)).filter(
        "reject_reason is not null"
    )


def split_rejects(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    accepted = checked.filter("reject_reason is null").drop("reject_reason")
    return accepted, checked.filter("reject_reason is not null")
