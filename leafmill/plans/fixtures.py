"""Library tables derived from the generated sample tables, in Spark and in SQL.

``SQL`` holds the same tables as common table expressions for the check.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators.ordering import arrange
from leafmill.operators.text_index import StoredIndex
from leafmill.operators.vocabulary import word_occurrences
from leafmill.session import fresh_path
from leafmill.sources.tables import sample_table, spread

# Signal features are made with these parameters on the short sample signals.
SIGNAL = {"rate": 16_000, "window": 32, "hop": 8, "n_mels": 4, "n_fft": 32}

# Dictionary of the sample decoding lines: 64 entries, entry 0 is the blank.
LINE_DICTIONARY = "_" + string.ascii_lowercase + string.ascii_uppercase + string.digits + "+"


def props_k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def books(spark: SparkSession, d: str) -> DataFrame:
    documents = sample_table(spark, d, "documents").select("doc_id", "source", "lang")
    labels = sample_table(spark, d, "labels").select(F.col("doc_id"), F.lit(1).alias("labelled"))
    per_source = documents.join(labels, "doc_id", "left").groupBy("source").agg(
        F.min("lang").alias("author"),
        F.count(F.lit(1)).cast("int").alias("total_pages"),
        F.count("labelled").cast("int").alias("pages_captured"),
        F.min("doc_id").alias("created_at"),
    )
    is_pdf = F.col("created_at") % 2 == 0
    return per_source.select(
        F.col("source").alias("id"),
        F.concat(F.lit("Book "), F.col("source")).alias("title"),
        "author", "total_pages", "pages_captured",
        is_pdf.alias("is_pdf"),
        F.when(is_pdf, F.concat(F.lit("/pdfs/"), F.col("source"), F.lit(".pdf"))).alias("pdf_path"),
        "created_at",
    )


def unnumbered_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages without page numbers, for work that does not look at them."""
    return _as_pages(documents(spark, d))


_PAGE_INDEXES: dict[tuple[str, str], StoredIndex] = {}


def page_index(spark: SparkSession, d: str) -> StoredIndex:
    """The stored index over the texts of all pages, which the searches of a session share."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _PAGE_INDEXES:
        index = StoredIndex(spark, fresh_path(spark, "page-index"), "id", ("ocr_text_plain",))
        _PAGE_INDEXES[key] = index.create(unnumbered_pages(spark, d).select("id", "ocr_text_plain"))
    return _PAGE_INDEXES[key]


def documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents on all cores, for work on their texts."""
    return spread(sample_table(spark, d, "documents"))


def _as_pages(table: DataFrame) -> DataFrame:
    return table.select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("book_id"),
        F.col("text").alias("ocr_markdown"),
        F.replace("text", F.lit("\n"), F.lit(" ")).alias("ocr_text_plain"),
    )


def pages(spark: SparkSession, d: str, book_id: str | None = None) -> DataFrame:
    """Pages numbered in each book by document id; with ``book_id`` those of one book.

    Only ids are numbered; the texts meet their numbers by id. A book is chosen in the scan of the texts too.
    """
    table = _as_pages(sample_table(spark, d, "documents"))
    if book_id is not None:
        table = table.where(F.col("book_id") == book_id)
    table = table.drop("book_id")
    return table.join(page_numbers(spark, d, book_id), "id").select(
        "id", "book_id", "ocr_markdown", "ocr_text_plain", "page_number"
    )


def page_numbers(spark: SparkSession, d: str, book_id: str | None = None) -> DataFrame:
    """``(id, book_id, page_number)`` without the texts. A book is chosen before its pages are numbered."""
    ids = sample_table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("book_id"))
    if book_id is not None:
        ids = ids.where(F.col("book_id") == book_id)
    rows = arrange(ids, ["book_id"], [F.col("id")], "page_number").df
    return rows.select("id", "book_id", F.col("page_number").cast("int").alias("page_number"))


def with_page_number(found: DataFrame, column: str, spark: SparkSession, d: str) -> DataFrame:
    """``found`` with the id of a page in ``column`` replaced by its number.

    Pages of a book are numbered in the order of their ids, so firsts are found by id and only they are numbered.
    """
    numbers = page_numbers(spark, d).select(F.col("id").alias("_page"), F.col("page_number").alias("_number"))
    joined = found.join(numbers, F.col(column) == F.col("_page"))
    return joined.withColumn(column, F.col("_number")).drop("_page", "_number")


def words(spark: SparkSession, d: str) -> DataFrame:
    return word_occurrences(
        pages(spark, d), "ocr_text_plain", ["id", "book_id", "page_number"]
    )


def notes(spark: SparkSession, d: str) -> DataFrame:
    turns = sample_table(spark, d, "conversations")
    places = turns.select("conv_id", "turn")
    numbers = arrange(places, [], [F.col("conv_id"), F.col("turn")], "id").df
    return turns.join(numbers, ["conv_id", "turn"]).select(
        "id",
        F.col("role").alias("book_title"),
        F.col("turn").cast("int").alias("page_number"),
        F.col("text").alias("user_memo"),
        F.lit(None).cast("string").alias("tags"),
        F.col("id").alias("created_seq"),
        F.substring("text", 1, 60).alias("ocr_text_plain"),
        F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("voice_transcript"),
    )


def annotations(spark: SparkSession, d: str) -> DataFrame:
    events = sample_table(spark, d, "events")
    kind = F.col("event_type")
    mapped = (
        F.when(kind == "click", "highlight").when(kind == "view", "bookmark")
        .when(kind == "purchase", "note").when(kind == "signup", "Highlight").otherwise(kind)
    )
    start = F.when(mapped != "bookmark", F.floor("value").cast("int"))
    return events.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("src"), (F.col("user_id") % 22).cast("string")).alias("book_id"),
        props_k().alias("page_number"),
        mapped.alias("annotation_type"),
        kind.alias("content"),
        F.when(mapped == "highlight", "yellow").alias("color"),
        start.alias("position_start"),
        (start + 10).alias("position_end"),
        F.when(mapped == "note", F.col("props")).alias("user_note"),
        F.col("ts").alias("created_at"),
    )


def progress_log(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    status = (
        F.when(kind == "view", "processing").when(kind == "purchase", "completed")
        .when(kind == "error", "failed").otherwise("pending")
    )
    return sample_table(spark, d, "events").select(
        F.col("user_id").alias("book_id"),
        props_k().alias("last_processed_page"),
        F.lit(100).alias("total_pages"),
        status.alias("status"),
        F.col("ts").alias("updated_at"),
        F.col("event_id").alias("seq"),
    )


def patches(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    return sample_table(spark, d, "events").select(
        F.col("user_id").alias("id"),
        "ts",
        F.col("event_id").alias("seq"),
        F.when(kind.isin("click", "view"), kind).alias("content"),
        F.when(props_k() % 3 == 0, "blue").alias("color"),
        F.when(kind == "purchase", F.floor("value").cast("int")).alias("position_start"),
    )


def patch_targets(spark: SparkSession, d: str) -> DataFrame:
    return sample_table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"),
        F.lit("orig").alias("content"),
        F.lit("yellow").alias("color"),
        F.lit(0).alias("position_start"),
        F.lit(0).cast("long").alias("updated_at"),
    )


def regions(spark: SparkSession, d: str) -> DataFrame:
    lines = sample_table(spark, d, "lineitem")
    parts = sample_table(spark, d, "part").select("p_partkey", F.col("p_name").alias("text"))
    order = [
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
        "l_tax", "l_shipdate",
    ]
    needed = lines.select("l_orderkey", "l_returnflag", *order)
    numbered = arrange(needed, ["l_orderkey"], [F.col(c) for c in order], "ix").df
    named = numbered.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    x1 = F.col("l_quantity") * 4
    y1 = (F.col("l_partkey") % 12 * 8).cast("double")
    vertical = F.col("l_returnflag") == "R"
    return named.select(
        F.col("l_orderkey").alias("page_id"),
        "ix",
        x1.alias("x1"), y1.alias("y1"), (x1 + 100).alias("x2"), (y1 + 20).alias("y2"),
        (F.lit(1.0) - F.col("l_discount")).alias("confidence"),
        vertical.alias("is_vertical"),
        F.when(vertical, 90).otherwise(0).alias("direction"),
        "text",
    )


def samples(spark: SparkSession, d: str) -> DataFrame:
    events = sample_table(spark, d, "events").select("user_id", "ts", "event_id", "value")
    rows = arrange(events, ["user_id"], [F.col("ts"), F.col("event_id")], "n")
    return rows.df.select(
        F.col("user_id").alias("signal_id"),
        (F.col("n") - 1).alias("sample_ix"),
        F.col("value").alias("sample"),
    )


def decoding_steps(spark: SparkSession, d: str) -> DataFrame:
    vectors = sample_table(spark, d, "embeddings")
    rows = arrange(vectors, ["label"], [F.col("vec_id")], "n")
    return rows.df.select(
        F.col("label").alias("line_id"), (F.col("n") - 1).alias("t"), F.col("embedding").alias("probs")
    )


def line_dictionary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(LINE_DICTIONARY)), "id int, token string")


SQL = {
    "fx_books": """
        SELECT d.source AS id, 'Book ' || d.source AS title, min(d.lang) AS author,
               count(*)::INTEGER AS total_pages, count(l.doc_id)::INTEGER AS pages_captured,
               min(d.doc_id) % 2 = 0 AS is_pdf,
               CASE WHEN min(d.doc_id) % 2 = 0 THEN '/pdfs/' || d.source || '.pdf' END AS pdf_path,
               min(d.doc_id) AS created_at
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.source""",
    "fx_pages": """
        SELECT doc_id AS id, source AS book_id,
               (row_number() OVER (PARTITION BY source ORDER BY doc_id))::INTEGER AS page_number,
               text AS ocr_markdown, replace(text, chr(10), ' ') AS ocr_text_plain
        FROM documents""",
    "fx_words": """
        SELECT id, book_id, page_number, (pos - 1)::INTEGER AS pos, lower(w) AS word
        FROM (SELECT id, book_id, page_number, unnest(ws) AS w,
                     unnest(range(1, len(ws) + 1)) AS pos
              FROM (SELECT id, book_id, page_number,
                           list_filter(regexp_split_to_array(ocr_text_plain, '\\s+'),
                               lambda x: strlen(x) > 2 AND regexp_full_match(x, '\\p{L}+')) AS ws
                    FROM fx_pages))""",
    "fx_notes": """
        SELECT row_number() OVER (ORDER BY conv_id, turn) AS id, role AS book_title,
               turn::INTEGER AS page_number, text AS user_memo, NULL::VARCHAR AS tags,
               row_number() OVER (ORDER BY conv_id, turn) AS created_seq,
               substring(text, 1, 60) AS ocr_text_plain, 'turn ' || turn::VARCHAR AS voice_transcript
        FROM conversations""",
    "fx_annotations": """
        SELECT id, book_id, page_number, annotation_type, content,
               CASE WHEN annotation_type = 'highlight' THEN 'yellow' END AS color,
               CASE WHEN annotation_type <> 'bookmark' THEN floor(value)::INTEGER END AS position_start,
               CASE WHEN annotation_type <> 'bookmark' THEN floor(value)::INTEGER + 10 END AS position_end,
               CASE WHEN annotation_type = 'note' THEN props END AS user_note, created_at
        FROM (SELECT event_id AS id, 'src' || (user_id % 22)::VARCHAR AS book_id,
                     regexp_extract(props, '"k": (\\d+)', 1)::INTEGER AS page_number,
                     CASE event_type WHEN 'click' THEN 'highlight' WHEN 'view' THEN 'bookmark'
                          WHEN 'purchase' THEN 'note' WHEN 'signup' THEN 'Highlight'
                          ELSE event_type END AS annotation_type,
                     event_type AS content, value, props, ts AS created_at FROM events)""",
    "fx_progress": """
        SELECT user_id AS book_id, regexp_extract(props, '"k": (\\d+)', 1)::INTEGER AS last_processed_page,
               100 AS total_pages,
               CASE event_type WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'completed'
                    WHEN 'error' THEN 'failed' ELSE 'pending' END AS status,
               ts AS updated_at, event_id AS seq FROM events""",
    "fx_patches": """
        SELECT user_id AS id, ts, event_id AS seq,
               CASE WHEN event_type IN ('click', 'view') THEN event_type END AS content,
               CASE WHEN regexp_extract(props, '"k": (\\d+)', 1)::INTEGER % 3 = 0 THEN 'blue' END AS color,
               CASE WHEN event_type = 'purchase' THEN floor(value)::INTEGER END AS position_start
        FROM events""",
    "fx_patch_target": """
        SELECT c_custkey AS id, 'orig' AS content, 'yellow' AS color, 0 AS position_start,
               0::BIGINT AS updated_at FROM customer""",
    "fx_regions": """
        SELECT l_orderkey AS page_id,
               row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,
                   l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS ix,
               l_quantity * 4 AS x1, (l_partkey % 12 * 8)::DOUBLE AS y1,
               l_quantity * 4 + 100 AS x2, (l_partkey % 12 * 8)::DOUBLE + 20 AS y2,
               1.0::DOUBLE - l_discount AS confidence, l_returnflag = 'R' AS is_vertical,
               CASE WHEN l_returnflag = 'R' THEN 90 ELSE 0 END AS direction, p_name AS text
        FROM lineitem JOIN part ON p_partkey = l_partkey""",
    "fx_signal": """
        SELECT user_id AS signal_id,
               row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sample_ix,
               value AS sample FROM events""",
    "fx_logits": """
        SELECT label AS line_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t,
               embedding AS probs FROM embeddings""",
}

# Which tables a table is made from.
_NEEDS = {"fx_words": ("fx_pages",)}


def with_tables(names: str, body: str) -> str:
    """``body`` after the definitions of the space-separated fixture tables."""
    ordered: list[str] = []
    for name in names.split():
        for needed in (*_NEEDS.get(name, ()), name):
            if needed not in ordered:
                ordered.append(needed)
    ctes = ", ".join(f"{n} AS ({SQL[n]})" for n in ordered)
    text = body.strip()
    if text.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {text[len('WITH RECURSIVE '):]}"
    if text.upper().startswith("WITH "):
        return f"WITH {ctes}, {text[len('WITH '):]}"
    return f"WITH {ctes} {text}"
