"""Adding rows to catalog tables: defaults, ids, stamps, partitioned appends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.operators.audits import check_unique, first_broken_rule, split_rejects
from leafmill.operators.ordering import GROUP_ROWS, arrange
from leafmill.schemas import ANNOTATION_TYPES, DEFAULTS, PARTITIONS, STAMPS, TABLES
from leafmill.sources.files import hash_id


def with_defaults(rows: DataFrame, table: str, now: Column) -> DataFrame:
    """Rows in the table's shape: absent columns null, defaults filled, times stamped.

    ``now`` is seconds since the epoch or a timestamp, as the table stores it.
    """
    columns = []
    for field in TABLES[table].fields:
        value = F.col(field.name) if field.name in rows.columns else F.lit(None)
        if field.name in STAMPS[table]:
            value = now
        elif field.name in DEFAULTS[table]:
            value = F.coalesce(value, F.lit(DEFAULTS[table][field.name]))
        columns.append(value.cast(field.dataType).alias(field.name))
    return rows.select(*columns)


def next_ids(
    rows: DataFrame, target: DataFrame, order: list[Column], group_rows: int = GROUP_ROWS
) -> DataFrame:
    """Consecutive ids after the target's largest, in ``order``.

    Large inputs are numbered partition by partition.
    """
    numbered = arrange(rows, [], order, "_n", group_rows).df
    largest = target.agg(F.coalesce(F.max("id"), F.lit(0).cast("long"))).scalar()
    return numbered.withColumn("id", F.col("_n") + largest).drop("_n")


def with_hash_ids(rows: DataFrame, *identity: str) -> DataFrame:
    """Text ids for rows that have none, from the columns that identify them."""
    made = hash_id(*[F.col(c) for c in identity])
    given = F.col("id") if "id" in rows.columns else F.lit(None).cast("string")
    return rows.withColumn("id", F.coalesce(given, made))


def required_rules(table: str, stamped: bool = True) -> list[tuple[str, Column]]:
    """NOT NULL columns of a table (and the annotation types) as audit rules."""
    skip = {"id", *(STAMPS[table] if stamped else ())}
    rules = [
        (f"{f.name} is null", F.col(f.name).isNotNull())
        for f in TABLES[table].fields
        if not f.nullable and f.name not in skip
    ]
    if table == "annotations":
        rules.append(("unknown annotation type", F.col("annotation_type").isin(*ANNOTATION_TYPES)))
    return rules


def accept_rows(rows: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """Rows that keep the table's rules, and the others with ``reject_reason``."""
    reason = first_broken_rule(required_rules(table))
    return split_rejects(rows.withColumn("reject_reason", reason))


def accept_pages(pages: DataFrame, stored: DataFrame, seq: str) -> tuple[DataFrame, DataFrame]:
    """Pages whose (book, page) is new, and the others with ``reject_reason``."""
    return split_rejects(check_unique(stored, pages, ["book_id", "page_number"], seq))


def append(rows: DataFrame, root: str, table: str) -> None:
    """Append to a table of a catalog folder, partitioned where the table is."""
    writer = rows.write.mode("append")
    if table in PARTITIONS:
        writer = writer.partitionBy(PARTITIONS[table])
    writer.parquet(f"{root}/{table}")
