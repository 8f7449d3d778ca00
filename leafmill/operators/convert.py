"""Conversion of books to text: work plans, progress, throughput."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.operators.ordering import GROUP_ROWS, arrange

# Fixed value: pages per batch.
BATCH_PAGES = 10
# Usual steps from each status; stored progress may hold any other.
NEXT_STATUS = {
    "pending": ("pending", "processing", "failed"),
    "processing": ("processing", "completed", "failed"),
    "completed": ("pending",),
    "failed": ("pending",),
}


def page_sequence(books: DataFrame) -> DataFrame:
    """One row per page of each book with a known positive page count."""
    known = books.filter("total_pages > 0")
    return known.select(
        F.col("id").alias("book_id"), "total_pages",
        F.explode(F.sequence(F.lit(1), "total_pages")).alias("page_number"),
    )


def remaining_pages(books: DataFrame, finished: DataFrame) -> DataFrame:
    """Pages not finished yet; (book, page) is unique, so the join is even."""
    return page_sequence(books).join(
        finished.select("book_id", "page_number"), ["book_id", "page_number"], "left_anti"
    )


def batch_number(page_index: Column, size: int = BATCH_PAGES) -> Column:
    return F.floor(page_index / size).cast("int")


def work_plan(books: DataFrame, finished: DataFrame | None = None) -> DataFrame:
    """Pages to convert with the 0-based batch their page number falls in."""
    pages = page_sequence(books) if finished is None else remaining_pages(books, finished)
    return pages.withColumn("batch", batch_number(F.col("page_number") - 1))


def batch_sizes(plan: DataFrame) -> DataFrame:
    return plan.groupBy("book_id", "batch").agg(
        F.count(F.lit(1)).alias("pages"), F.min("page_number").alias("first_page"),
        F.max("page_number").alias("last_page"),
    )


def spread_plan(plan: DataFrame) -> DataFrame:
    """Plan placed for the work: by book and batch, so one large book uses many tasks."""
    return plan.repartition("book_id", "batch")


def sampled_progress(plan: DataFrame, every: int = BATCH_PAGES) -> DataFrame:
    """Progress reports: each ``every``-th page of a book, and its last page."""
    index = F.col("page_number") - 1
    return plan.filter((index % every == 0) | (index == F.col("total_pages") - 1))


def progress_transitions(
    log: DataFrame,
    key: str = "book_id",
    group_rows: int = GROUP_ROWS,
    steps: Mapping[str, Sequence[str]] = NEXT_STATUS,
) -> DataFrame:
    """Log rows with the status before (``pending`` at first) and whether the step is allowed.

    ``log`` has the key, updated_at, seq and status; ``steps`` names the statuses that may follow each.
    """
    order = [F.col("updated_at"), F.col("seq")]
    rows = arrange(log, [key], order, "step", group_rows).lag({"_before": "status"})
    before = F.coalesce("_before", F.lit("pending"))
    pairs = [
        x for s, nexts in steps.items()
        for x in (F.lit(s), F.array(*[F.lit(n) for n in nexts]))
    ]
    allowed = F.array_contains(F.create_map(*pairs)[before], F.col("status"))
    return rows.df.withColumns(
        {"before": before, "allowed": F.coalesce(allowed, F.lit(False))}
    ).drop("_before")


def throughput(batches: DataFrame) -> DataFrame:
    """Per book: pages, batches, time per batch and pages per second.

    ``batches`` has book_id, pages and elapsed_ms, one row per finished batch.
    """
    pages, time = F.sum("pages"), F.sum("elapsed_ms")
    return batches.groupBy("book_id").agg(
        pages.alias("pages"), F.count(F.lit(1)).alias("batches"),
        time.alias("elapsed_ms"), F.avg("elapsed_ms").alias("ms_per_batch"),
        F.when(time > 0, pages * 1000.0 / time).alias("pages_per_second"),
    )
