"""Changes to stored rows: patches, replacements, upserts, deletes, log folds.

Tables are immutable files, so each operator returns the new table. Logs are
folded to one row per key by aggregates, which combine before the shuffle; the
merge joins then see unique keys on both sides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _joined(target: DataFrame, changes: DataFrame, key: str) -> tuple[DataFrame, Column]:
    renamed = changes.select(
        F.col(key), F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in changes.columns if c != key]
    )
    return target.join(renamed, key, "left"), F.coalesce(F.col("_hit"), F.lit(False))


def _finished(joined: DataFrame, target: DataFrame, values: dict[str, Column]) -> DataFrame:
    return joined.select(*[values.get(c, F.col(c)).alias(c) for c in target.columns])


def apply_patches(
    target: DataFrame,
    patches: DataFrame,
    key: str,
    columns: Sequence[str],
    touch: tuple[str, Column] | None = None,
) -> DataFrame:
    """Non-null patch values win; ``touch`` = (column, time) stamps patched rows."""
    joined, hit = _joined(target, patches.select(key, *columns), key)
    values = {c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) for c in columns}
    if touch:
        values[touch[0]] = F.when(hit, touch[1]).otherwise(F.col(touch[0]))
    return _finished(joined, target, values)


def replace_rows(
    target: DataFrame,
    rows: DataFrame,
    key: str,
    columns: Sequence[str],
    touch: tuple[str, Column] | None = None,
) -> DataFrame:
    """Given columns are overwritten, nulls included; unknown keys are ignored.

    Times stay as they are unless ``touch`` is given.
    """
    joined, hit = _joined(target, rows.select(key, *columns), key)
    values = {c: F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c)) for c in columns}
    if touch:
        values[touch[0]] = F.when(hit, touch[1]).otherwise(F.col(touch[0]))
    return _finished(joined, target, values)


def upsert(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows replace those with the same key and are added where there is none."""
    return target.join(rows.select(key), key, "left_anti").unionByName(rows)


def reset_progress(progress: DataFrame, books: DataFrame, now: Column) -> DataFrame:
    """Start conversion of books: progress becomes (0, total, pending)."""
    fresh = books.select(
        F.col("id").alias("book_id"),
        F.lit(0).alias("last_processed_page"),
        F.col("total_pages"),
        F.lit("pending").alias("status"),
        now.alias("updated_at"),
    )
    return upsert(progress, fresh, "book_id")


def update_progress(progress: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    """New last page and status for known books; unknown books change nothing."""
    return replace_rows(
        progress, updates, "book_id", ["last_processed_page", "status"], ("updated_at", now)
    )


def update_definitions(words: DataFrame, definitions: DataFrame, now: Column) -> DataFrame:
    """New definition and its ``ai_generated`` flag for known words, by id."""
    return replace_rows(
        words, definitions, "id", ["definition", "ai_generated"], ("updated_at", now)
    )


def set_covers(books: DataFrame, covers: DataFrame) -> DataFrame:
    """Set cover paths by book id; a null path clears the cover."""
    return replace_rows(books, covers, "id", ["cover_path"])


def delete_keys(target: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return target.join(keys.select(key).distinct(), key, "left_anti")


def affected(target: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """One row: how many target rows a change by ``keys`` touches."""
    hits = target.select(key).join(keys.select(key).distinct(), key, "left_semi")
    return hits.agg(F.count(F.lit(1)).alias("affected"))


def affected_by_book(target: DataFrame, books: DataFrame) -> DataFrame:
    """Rows a delete by book removes, per book asked for (0 if none)."""
    asked = books.select("book_id").distinct()
    sizes = target.groupBy("book_id").agg(F.count(F.lit(1)).alias("n"))
    return asked.join(sizes, "book_id", "left").select(
        "book_id", F.coalesce("n", F.lit(0)).alias("affected")
    )


def fold_patches(log: DataFrame, key: str, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Per key, the last non-null value of each column in log order."""
    when = F.struct(*order)
    latest = [
        F.max_by(c, F.when(F.col(c).isNotNull(), when)).alias(c) for c in columns
    ]
    return log.groupBy(key).agg(*latest)


def fold_latest(log: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Per key, the last row of the log."""
    others = [c for c in log.columns if c != key]
    last = F.max_by(F.struct(*others), F.struct(*order)).alias("_row")
    return log.groupBy(key).agg(last).select(key, *[F.col(f"_row.{c}") for c in others])
