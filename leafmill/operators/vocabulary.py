"""Harvesting words, examples and definitions from page texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.functions.text import one_sentence_end, sentence_at, words
from leafmill.operators.joins import broadcast_if_small

# Built-in definitions by lower-cased word.
DEFINITIONS = {
    "test": "A procedure intended to establish the quality, performance, or reliability of something, especially before it is taken into use.",
    "example": "A thing characteristic of its kind or illustrating a general rule.",
    "word": "A single distinct meaningful element of speech or writing.",
    "definition": "A statement of the exact meaning of a word, especially in a dictionary.",
    "context": "The circumstances that form the setting for an event, statement, or idea, and in terms of which it can be fully understood.",
}

# Text around a word that has no built-in definition.
UNKNOWN_BEFORE = "[Mock AI] Definition for '"
UNKNOWN_AFTER = (
    "': This is a simulated definition for testing purposes. "
    "In production, this would be generated by the Qwen3.5-0.8B model."
)

# About as many characters of words and their sentences are held at once.
GIVEN_CHARACTERS = 1 << 22


def word_occurrences(pages: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """One row per word occurrence, with ``pos`` counting from 0 in its page."""
    # Exploding the expression itself keeps Spark from evaluating it once more in a
    # filter for non-empty arrays.
    return pages.select(*keep, F.posexplode(words(F.col(text))).alias("pos", "word"))


def word_counts(texts: DataFrame, text: str) -> DataFrame:
    """Occurrences of each word and the number of texts it occurs in.

    Each row is one text, so a text adds one (1, 0) entry per occurrence and one
    (0, 1) entry per distinct word. Both counts are then plain sums: one
    shuffle of at most a vocabulary per task and no distinct aggregate.
    """
    found = texts.select(words(F.col(text)).alias("w"))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")

    def entry(occurrence: Column, document: Column):
        return lambda w: F.struct(
            w.alias("word"), occurrence.alias("occurrence"), document.alias("document")
        )

    entries = F.concat(
        F.transform("w", entry(one, none)), F.transform(F.array_distinct("w"), entry(none, one))
    )
    return (
        found.select(F.inline(entries))
        .groupBy("word")
        .agg(F.sum("occurrence").alias("occurrences"), F.sum("document").alias("documents"))
    )


def vocabulary_rollup(occurrences: DataFrame, reviews: DataFrame) -> DataFrame:
    """Per word: occurrences, books, first book and page, reviews so far.

    ``occurrences`` has word, book_id, page_number; ``reviews`` has word and
    reviewed_at. Counting per (word, book) first keeps a frequent word spread out.
    """
    per_book = occurrences.groupBy("word", "book_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("page_number").alias("first_page")
    )
    first = F.min(F.struct("book_id", "first_page"))
    per_word = per_book.groupBy("word").agg(
        F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("books"), first.alias("_first")
    )
    reviewed = reviews.groupBy("word").agg(
        F.count(F.lit(1)).alias("review_count"), F.max("reviewed_at").alias("last_reviewed_at")
    )
    return per_word.join(reviewed, "word", "left").select(
        "word",
        "occurrences",
        "books",
        F.col("_first.book_id").alias("first_book"),
        F.col("_first.first_page").alias("first_page"),
        F.coalesce("review_count", F.lit(0)).alias("review_count"),
        "last_reviewed_at",
    )


def _examples(
    pages: DataFrame, wanted: DataFrame, keys: Sequence[str], text: str, place: bool = False
) -> DataFrame:
    """The first sentence of each wanted word on its page, with ``place`` its first position too.

    ``wanted`` has the page's ``keys`` and word. A page's wanted words travel as
    one array to the page's row, so a text is shuffled once however many words
    are looked up in it. A word is found in its text by a plain search that ends
    at its first place.
    """
    per_page = wanted.groupBy(*keys).agg(F.collect_list("word").alias("_wanted"))
    both = pages.join(per_page, list(keys)).select(*keys, F.col(text).alias("_text"), "_wanted")
    if place:
        # An array around the words keeps Spark from taking them out of the text again for each wanted one.
        at = F.transform(
            F.array(words(F.col("_text"))),
            lambda own: F.transform("_wanted", lambda w: (F.array_position(own, w) - 1).cast("int")),
        )
        both = both.withColumn("_at", at[0])
    kept = [T.StructField(k, both.schema[k].dataType) for k in keys]
    found = [T.StructField("word", T.StringType()), T.StructField("sentence", T.StringType())]
    schema = T.StructType([*kept, *found, *([T.StructField("pos", T.IntegerType())] if place else [])])
    return both.mapInArrow(_look_up(list(keys), schema.names), schema)


def _look_up(keys: list[str], names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows per wanted word from rows per page; sentences are given on as soon as they are many characters."""

    def out(pages: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
        page, word, sentence, at = zip(*found)
        last = [pa.array(word, pa.string()), pa.array(sentence, pa.string()), pa.array(at, pa.int32())]
        own = [pages.column(k).take(pa.array(page, pa.int32())) for k in keys]
        return pa.RecordBatch.from_arrays([*own, *last][: len(names)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pages in batches:
            found, characters = [], 0
            at = pages.column("_at") if "_at" in pages.schema.names else None
            for page, (text, wanted) in enumerate(zip(pages.column("_text"), pages.column("_wanted"))):
                marked = one_sentence_end(text.as_py() or "")
                for word, pos in zip(wanted.as_py(), at[page].as_py() if at is not None else repeat(None)):
                    sentence = sentence_at(marked, word)
                    found.append((page, word, sentence, pos))
                    characters += len(word) + len(sentence or "")
                    if characters >= GIVEN_CHARACTERS:
                        yield out(pages, found)
                        found, characters = [], 0
            if found:
                yield out(pages, found)

    return run


def first_occurrences(pages: DataFrame, text: str, page: str = "page_number") -> DataFrame:
    """Each word's first place in (book_id, ``page``, pos) order, with example.

    ``pages`` has book_id, the text and ``page``, any whole number that orders the pages of a book. Only the first page
    per word and book is looked for over the corpus, by one aggregate of fixed-width values; the position on it is
    taken where the example is.
    """
    keys = ["book_id", page]
    per_book = word_occurrences(pages, text, keys).groupBy("word", "book_id").agg(F.min(page).alias(page))
    first = per_book.groupBy("word").agg(F.min(F.struct(*keys)).alias("f"))
    found = _examples(pages.select(*keys, text), first.select("word", "f.*"), keys, text, place=True)
    return found.select(
        "word", F.col("book_id").alias("source_book"), F.col(page).alias("source_page"),
        "pos", F.col("sentence").alias("example_sentence"),
    )


def concordance(pages: DataFrame, targets: DataFrame, text: str) -> DataFrame:
    """For each page and target word extracted from it, the first sentence with it.

    Pages and targets meet by equality on the extracted words, never pair by pair.
    """
    found = pages.select("id", F.explode(F.array_distinct(words(F.col(text)))).alias("word"))
    wanted = found.join(broadcast_if_small(targets.select("word")), "word", "left_semi")
    return _examples(pages.select("id", text), wanted, ["id"], text)


def template_definition(word: Column) -> Column:
    return F.concat(F.lit(UNKNOWN_BEFORE), word, F.lit(UNKNOWN_AFTER))


def builtin_definition(word: Column) -> Column:
    """Definition from the built-in dictionary, else the template text."""
    pairs = [F.lit(x) for pair in DEFINITIONS.items() for x in pair]
    known = F.create_map(*pairs)[F.lower(word)]
    return F.coalesce(known, template_definition(word))


def add_definitions(
    rows: DataFrame, cache: DataFrame, generated: Column | None = None
) -> DataFrame:
    """Rows with ``definition``: the cached one of their word, else a generated one.

    ``cache`` has id, word and definition; only a non-null definition is a hit.
    """
    fallback = builtin_definition(F.col("word")) if generated is None else generated
    hits = (
        cache.filter("definition is not null")
        .groupBy("word")
        .agg(F.min_by("definition", "id").alias("_cached"))
    )
    return (
        rows.join(hits, "word", "left")
        .withColumn("definition", F.coalesce("_cached", fallback))
        .withColumn("ai_generated", F.col("_cached").isNull())
        .drop("_cached")
    )


def define_words(
    asked: DataFrame, cache: DataFrame, generated: Column | None = None
) -> DataFrame:
    """``(word, definition, ai_generated)`` of each distinct asked word."""
    return add_definitions(asked.select("word").distinct(), cache, generated)


def definitions_table(spark: SparkSession) -> DataFrame:
    """The built-in dictionary as a table, for joins."""
    return spark.createDataFrame(list(DEFINITIONS.items()), "word string, definition string")
