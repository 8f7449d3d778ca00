"""From page texts to a vocabulary list: words, examples, definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.operators.vocabulary import add_definitions, first_occurrences


def harvest(pages: DataFrame, text: str, cache: DataFrame, page: str = "page_number") -> DataFrame:
    """Vocabulary entries: each word with its first place, example and meaning.

    ``cache`` has id, word and definition of words defined before. ``page`` orders the pages of a book.
    """
    return add_definitions(first_occurrences(pages, text, page), cache).select(
        "word", F.col("definition").alias("meaning"), "example_sentence", "source_book",
        "source_page", F.lit(None).cast("string").alias("tags"), "ai_generated",
    )
