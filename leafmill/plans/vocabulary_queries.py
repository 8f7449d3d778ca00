"""Queries over words, examples, definitions and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.text import (
    HTML_REPLACEMENTS,
    PART_OF_SPEECH_LABELS,
    markdown_html,
    part_of_speech_label,
)
from leafmill.operators import export, vocabulary
from leafmill.plans import fixtures as fx
from leafmill.plans.registry import query
from leafmill.plans.vocabulary_harvest import harvest
from leafmill.session import fresh_path, keep
from leafmill.sources.tables import sample_table

_DOCUMENT_WORDS = """words AS (SELECT doc_id, lower(w) AS word FROM (
    SELECT doc_id, unnest(regexp_split_to_array(text, '\\s+')) AS w FROM documents)
    WHERE strlen(w) > 2 AND regexp_full_match(w, '\\p{L}+'))"""


@query(
    f"""WITH {_DOCUMENT_WORDS} SELECT word, count(*) AS occurrences, count(DISTINCT doc_id) AS documents
        FROM words GROUP BY word"""
)
def vocab_counts(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary.word_counts(fx.documents(spark, d), "text")


@query(
    """WITH reviews AS (SELECT lower(w) AS word, conv_id FROM (
           SELECT conv_id, unnest(regexp_split_to_array(text, '\\s+')) AS w FROM conversations)
           WHERE strlen(w) > 2 AND regexp_full_match(w, '\\p{L}+')),
       reviewed AS (SELECT word, count(*) AS n, max(conv_id) AS last FROM reviews GROUP BY word),
       per_word AS (SELECT word, count(*) AS occurrences, count(DISTINCT book_id) AS books,
                    min(book_id) AS first_book FROM fx_words GROUP BY word),
       pages_of AS (SELECT word, book_id, min(page_number) AS first_page FROM fx_words GROUP BY word, book_id)
       SELECT p.word, p.occurrences, p.books, p.first_book, q.first_page,
              coalesce(r.n, 0) AS review_count, coalesce(r.last, -1) AS last_reviewed_at
       FROM per_word p JOIN pages_of q ON q.word = p.word AND q.book_id = p.first_book
       LEFT JOIN reviewed r ON r.word = p.word""",
    "fx_words",
)
def vocab_rollup(spark: SparkSession, d: str) -> DataFrame:
    reviews = vocabulary.word_occurrences(
        sample_table(spark, d, "conversations"), "text", ["conv_id"]
    ).withColumnRenamed("conv_id", "reviewed_at")
    seen = vocabulary.word_occurrences(fx.unnumbered_pages(spark, d), "ocr_text_plain", ["id", "book_id"])
    rolled = vocabulary.vocabulary_rollup(seen.withColumnRenamed("id", "page_number"), reviews)
    rolled = fx.with_page_number(rolled, "first_page", spark, d)
    return rolled.withColumn("last_reviewed_at", F.coalesce("last_reviewed_at", F.lit(-1)))


_TRIM = r"""regexp_replace({0}, '^\s+|\s+$', '', 'g')"""

_FIRST = f"""first AS (SELECT word, book_id AS source_book, page_number AS source_page, pos, {_TRIM.format('sentence')} AS example_sentence
    FROM (SELECT w.word, w.book_id, w.page_number, w.pos,
        list_filter(regexp_split_to_array(p.ocr_text_plain, '[。.！!]'), lambda s: contains(s, w.word))[1] AS sentence
      FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY book_id, page_number, pos) AS n
            FROM fx_words) WHERE n = 1) w JOIN fx_pages p ON p.id = w.id))"""


@query(f"WITH {_FIRST} SELECT * FROM first", "fx_pages fx_words")
def vocab_first_occurrence(spark: SparkSession, d: str) -> DataFrame:
    found = vocabulary.first_occurrences(fx.unnumbered_pages(spark, d), "ocr_text_plain", "id")
    return fx.with_page_number(found, "source_page", spark, d)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_BUILTIN = " ".join(f"WHEN {_quoted(w)} THEN {_quoted(t)}" for w, t in vocabulary.DEFINITIONS.items())
_TEMPLATE = f"{_quoted(vocabulary.UNKNOWN_BEFORE)} || word || {_quoted(vocabulary.UNKNOWN_AFTER)}"
_CACHE = """cache AS (SELECT word, 'seen in ' || min(item_id)::VARCHAR AS definition FROM (
    SELECT item_id, lower(w) AS word FROM (
      SELECT item_id, unnest(regexp_split_to_array(text, '\\s+')) AS w FROM benchmark)
    WHERE strlen(w) > 2 AND regexp_full_match(w, '\\p{L}+')) GROUP BY word)"""


def _cache(spark: SparkSession, d: str) -> DataFrame:
    seen = vocabulary.word_occurrences(sample_table(spark, d, "benchmark"), "text", ["item_id"])
    return seen.select(
        F.col("item_id").alias("id"), "word",
        F.concat(F.lit("seen in "), F.col("item_id").cast("string")).alias("definition"),
    )


@query(
    f"""WITH {_CACHE}, asked AS (SELECT DISTINCT word FROM fx_words)
        SELECT a.word, coalesce(c.definition, CASE a.word {_BUILTIN} ELSE
               {_TEMPLATE.replace('|| word ||', '|| a.word ||')} END) AS definition,
               c.word IS NULL AS ai_generated
        FROM asked a LEFT JOIN cache c ON c.word = a.word""",
    "fx_words",
)
def word_definitions(spark: SparkSession, d: str) -> DataFrame:
    asked = vocabulary.word_occurrences(fx.unnumbered_pages(spark, d), "ocr_text_plain", [])
    return vocabulary.define_words(asked, _cache(spark, d))


@query(
    f"""WITH {_DOCUMENT_WORDS}, asked AS (SELECT DISTINCT lower(w) AS word FROM (
            SELECT unnest(regexp_split_to_array(text, '\\s+')) AS w FROM benchmark)
            WHERE strlen(w) > 2 AND regexp_full_match(w, '\\p{{L}}+')),
        hits AS (SELECT DISTINCT doc_id, word FROM words WHERE word IN (SELECT word FROM asked))
        SELECT h.doc_id AS id, h.word, {_TRIM.format("list_filter(regexp_split_to_array(d.text, '[。.！!]'), lambda s: contains(s, h.word))[1]")} AS sentence
        FROM hits h JOIN documents d ON d.doc_id = h.doc_id"""
)
def concordance(spark: SparkSession, d: str) -> DataFrame:
    """Every word of the benchmark texts in every document."""
    asked = fx.word_occurrences(sample_table(spark, d, "benchmark"), "text", []).select("word").distinct()
    pages = fx.documents(spark, d).select(F.col("doc_id").alias("id"), "text")
    # Kept, as the size check and the join both read it.
    return vocabulary.concordance(pages, keep(asked), "text")


_ENTRIES = f"""{_FIRST}, {_CACHE}, entries AS (SELECT f.word, c.definition AS meaning, f.example_sentence,
    f.source_book, f.source_page, NULL::VARCHAR AS tags FROM first f LEFT JOIN cache c ON c.word = f.word)"""


def _entries(spark: SparkSession, d: str) -> DataFrame:
    """Harvested words with a meaning only where one was cached."""
    entries = harvest(fx.unnumbered_pages(spark, d), "ocr_text_plain", _cache(spark, d), "id")
    entries = fx.with_page_number(entries, "source_page", spark, d)
    return entries.withColumn("meaning", F.when(~F.col("ai_generated"), F.col("meaning"))).drop("ai_generated")


@query(f"WITH {_ENTRIES} SELECT word, meaning, example_sentence, source_book, source_page FROM entries", "fx_pages fx_words")
def vocab_harvest(spark: SparkSession, d: str) -> DataFrame:
    return _entries(spark, d).select("word", "meaning", "example_sentence", "source_book", "source_page")


@query(
    f"""WITH {_ENTRIES} SELECT '## ' || word || chr(10)
        || coalesce('**Meaning**: ' || meaning || chr(10), '')
        || coalesce('**Example**: ' || example_sentence || chr(10), '')
        || coalesce('**Source**: ' || source_book || ' (p.' || coalesce(source_page, 0)::VARCHAR || ')' || chr(10), '') AS value
        FROM entries UNION ALL SELECT '# Vocabulary List' || chr(10)""",
    "fx_pages fx_words",
)
def vocab_export_md(spark: SparkSession, d: str) -> DataFrame:
    return export.markdown_lines(_entries(spark, d))


@query(
    f"""WITH {_ENTRIES} SELECT word, '"' || word || '","' || coalesce(meaning, '') || '","'
        || coalesce(example_sentence, '') || '","' || coalesce(source_book, '') || '","'
        || coalesce(source_page, 0)::VARCHAR || '","' || coalesce(tags, '') || '"' AS line FROM entries""",
    "fx_pages fx_words",
)
def vocab_export_csv_lines(spark: SparkSession, d: str) -> DataFrame:
    return _entries(spark, d).select("word", export.csv_line().alias("line"))


@query(f"WITH {_ENTRIES} SELECT word, meaning, example_sentence, source_book, source_page, 6 AS fields FROM entries", "fx_pages fx_words")
def vocab_export_json(spark: SparkSession, d: str) -> DataFrame:
    entries = _entries(spark, d)
    lines = entries.select(export.json_entry(entries).alias("json"))
    parsed = F.from_json("json", entries.schema)
    return lines.select(
        parsed.alias("e"), F.size(F.json_object_keys("json")).alias("fields")
    ).select("e.word", "e.meaning", "e.example_sentence", "e.source_book", "e.source_page", "fields")


@query(
    f"""WITH {_ENTRIES} SELECT word, coalesce(meaning, '') AS meaning, coalesce(example_sentence, '') AS example_sentence,
        coalesce(source_book, '') AS source_book, coalesce(source_page, 0)::VARCHAR AS source_page FROM entries""",
    "fx_pages fx_words",
)
def vocab_export_csv_file(spark: SparkSession, d: str) -> DataFrame:
    """Entries written as CSV files and read back."""
    path = fresh_path(spark, "export")
    export.export_vocabulary(_entries(spark, d), "csv", path)
    back = spark.read.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    columns = ["word", "meaning", "example_sentence", "source_book", "source_page"]
    return back.select(*[F.coalesce(c, F.lit("")).alias(c) for c in columns])


_LABELS = " ".join(f"WHEN {i} THEN {_quoted(v)}" for i, v in enumerate(PART_OF_SPEECH_LABELS.values()))


@query(f"SELECT DISTINCT word, CASE length(word) % 6 {_LABELS} END AS label FROM fx_words", "fx_words")
def part_of_speech(spark: SparkSession, d: str) -> DataFrame:
    seen = vocabulary.word_occurrences(fx.unnumbered_pages(spark, d), "ocr_text_plain", [])
    codes = F.array(*[F.lit(c) for c in PART_OF_SPEECH_LABELS])
    code = F.get(codes, F.char_length("word") % 6)
    return seen.select("word").distinct().select("word", part_of_speech_label(code).alias("label"))


def _replaced(column: str) -> str:
    text = column
    for old, new in HTML_REPLACEMENTS:
        text = f"replace({text}, {_quoted(old)}, {_quoted(new)})"
    return f"'<p>' || {text} || '</p>'"


@query(f"SELECT doc_id, {_replaced('text')} AS html FROM documents")
def markdown_to_html(spark: SparkSession, d: str) -> DataFrame:
    documents = fx.documents(spark, d)
    return documents.select("doc_id", markdown_html(F.col("text")).alias("html"))
