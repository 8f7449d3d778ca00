"""Reading the catalog: lookups, filters, orders, the book/page join, feeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.schemas import ANNOTATION_TYPES


def by_keys(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``table`` whose key is asked for; 0 or 1 row per key."""
    return table.join(keys.select(key).distinct(), key, "left_semi")


def by_key(table: DataFrame, key: str, value: object) -> DataFrame:
    return table.filter(F.col(key) == value)


def word_by_text(words: DataFrame, asked: DataFrame, order: Sequence[str] = ("id",)) -> DataFrame:
    """For each asked word, the stored row that is first in ``order`` (case-sensitive).

    Rows are reduced to one per word first, on the map side already; only those meet the asked words.
    """
    others = [c for c in words.columns if c != "word"]
    first = words.groupBy("word").agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_row"))
    hits = first.join(asked.select("word"), "word", "left_semi")
    return hits.select("word", "_row.*").select(*words.columns)


def pages_of_book(pages: DataFrame, book_id: str) -> DataFrame:
    return pages.filter(F.col("book_id") == book_id).orderBy("page_number")


def annotations_of_book(annotations: DataFrame, book_id: str, kind: str | None = None) -> DataFrame:
    """Annotations of a book by page and start; a missing start comes first."""
    found = annotations.filter(F.col("book_id") == book_id)
    if kind is not None:
        found = found.filter(F.col("annotation_type") == kind)
    return found.orderBy("page_number", F.col("position_start").asc_nulls_first(), "id")


def highlights(annotations: DataFrame, book_id: str) -> DataFrame:
    return annotations_of_book(annotations, book_id, "highlight")


def bookmarks(annotations: DataFrame, book_id: str) -> DataFrame:
    return annotations_of_book(annotations, book_id, "bookmark")


def notes(annotations: DataFrame, book_id: str) -> DataFrame:
    return annotations_of_book(annotations, book_id, "note")


def annotations_by_kind(annotations: DataFrame, book_id: str) -> DataFrame:
    """Highlights, bookmarks and notes of a book, in this order and each by page and start, from one scan."""
    kind = F.col("annotation_type")
    found = annotations.filter((F.col("book_id") == book_id) & kind.isin(*ANNOTATION_TYPES))
    place = F.array_position(F.array(*map(F.lit, ANNOTATION_TYPES)), kind)
    return found.orderBy(place, "page_number", F.col("position_start").asc_nulls_first(), "id")


def words_of_book(words: DataFrame, book_id: str) -> DataFrame:
    return words.filter(F.col("source_book_id") == book_id).orderBy("word")


def generated_words(words: DataFrame) -> DataFrame:
    return words.filter(F.col("ai_generated")).orderBy(F.desc("created_at"), F.desc("id"))


def words_matching(words: DataFrame, text: str, prefix: bool = False) -> DataFrame:
    column = F.col("word")
    return words.filter(column.startswith(text) if prefix else column.contains(text))


def library(books: DataFrame, which: str = "all") -> DataFrame:
    """Books of one kind: ``all``, ``pdf`` or ``physical``."""
    chosen = {
        "all": F.lit(True),
        "pdf": F.col("is_pdf"),
        "physical": ~F.col("is_pdf"),
    }[which]
    return books.filter(chosen)


def shelves(books: DataFrame) -> DataFrame:
    """Every book on each shelf it belongs to (``shelf``: all, pdf, physical), from one scan."""
    names = F.array_compact(F.array(F.lit("all"), F.when(F.col("is_pdf"), "pdf"), F.when(~F.col("is_pdf"), "physical")))
    return books.select(F.explode(names).alias("shelf"), *books.columns)


def progress_percent(done: Column, total: Column) -> Column:
    """Whole percent, truncated, in single precision; 0 without a positive total."""
    share = (done / total).cast("float") * F.lit(100.0).cast("float")
    return F.when(total > 0, share.cast("int")).otherwise(F.lit(0))


def needs_conversion(books: DataFrame) -> Column:
    known = F.coalesce(books.total_pages, F.lit(0))
    return books.is_pdf & (known > 0) & (books.pages_captured < known)


def conversion_action(books: DataFrame) -> Column:
    label = F.when(books.pages_captured > 0, "Resume Conversion").otherwise("Convert")
    return F.when(needs_conversion(books), label)


def page_at_scroll(scroll: Column, height: Column, pages: Column) -> Column:
    """Page under a scroll position, between 1 and the page count."""
    page_height = (height.cast("float") / pages.cast("float")).cast("float")
    page = (scroll.cast("float") / page_height).cast("float") + F.lit(1.0).cast("float")
    return F.greatest(F.least(page.cast("int"), pages.cast("int")), F.lit(1))


def check_page_refs(rows: DataFrame, books: DataFrame) -> DataFrame:
    """Rows with ``valid`` telling whether their page exists in their book."""
    totals = books.select(F.col("id").alias("book_id"), "total_pages")
    page = F.col("page_number")
    valid = F.coalesce((page >= 1) & (page <= F.col("total_pages")), F.lit(False))
    return rows.join(totals, "book_id", "left").withColumn("valid", valid)


def required_present(*columns: str) -> Column:
    present = F.lit(True)
    for name in columns:
        present = present & (F.coalesce(F.col(name), F.lit("")) != "")
    return present


def annotation_type(text: Column) -> Column:
    """The annotation type a text names in any case; null if it names none."""
    lowered = F.lower(text)
    return F.when(lowered.isin(*ANNOTATION_TYPES), lowered)


def type_flags(annotations: DataFrame) -> DataFrame:
    """``is_highlight``, ``is_bookmark``, ``is_note`` by the exact stored text."""
    return annotations.withColumns(
        {f"is_{t}": F.col("annotation_type") == t for t in ANNOTATION_TYPES}
    )


def books_by_title(books: DataFrame) -> DataFrame:
    return books.orderBy("title", "id")


def notes_newest_first(notes_table: DataFrame, limit: int | None = None) -> DataFrame:
    """Notes by time, newest first; with ``limit`` a top-k, never a full sort."""
    ordered = notes_table.orderBy(F.desc("created_seq"))
    return ordered if limit is None else ordered.limit(limit)


def books_with_pages(books: DataFrame, pages: DataFrame) -> DataFrame:
    """Every book with its pages; a book without pages keeps one row.

    An outer join cannot split a book with very many pages, as it must see all
    of them to know that there is one. So books with pages are an inner join,
    and the others are found from the distinct ids.
    """
    named = books.select(F.col("id").alias("book_id"), "title", "author", "total_pages")
    paged = named.join(pages, "book_id")
    empty = named.join(pages.select("book_id").distinct(), "book_id", "left_anti")
    return paged.unionByName(empty, allowMissingColumns=True)


def annotation_feed(annotations: DataFrame, columns: Sequence[str], own: dict[str, Sequence[str]]) -> DataFrame:
    """Annotations of the kinds in ``own`` as one table from one scan, with the common ``columns``.

    ``own`` names the further columns of each kind; they are null for kinds that lack them.
    """
    kind = F.col("annotation_type")
    optional = sorted({c for names in own.values() for c in names})
    values = [F.when(kind.isin(*[k for k, names in own.items() if c in names]), F.col(c)).alias(c) for c in optional]
    return annotations.filter(kind.isin(*own)).select(*columns, kind, *values)


def annotation_feeds(highlighted: DataFrame, bookmarked: DataFrame, noted: DataFrame) -> DataFrame:
    """Three feeds as one annotations table; columns a feed lacks are null."""
    parts = [
        feed.withColumn("annotation_type", F.lit(kind))
        for kind, feed in zip(ANNOTATION_TYPES, (highlighted, bookmarked, noted))
    ]
    first, second, third = parts
    return first.unionByName(second, allowMissingColumns=True).unionByName(
        third, allowMissingColumns=True
    )
