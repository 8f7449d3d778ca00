"""Queries over books, pages, notes and annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import clock
from leafmill.functions import documents as docs
from leafmill.functions.geometry import resized
from leafmill.functions.text import preview
from leafmill.operators import audits, catalog, merge, writes
from leafmill.operators.signal import with_reject_reason
from leafmill.operators.stored_table import StoredTable
from leafmill.plans import fixtures as fx
from leafmill.plans.registry import query
from leafmill.schemas import ANNOTATION_TYPES
from leafmill.session import fresh_path, keep
from leafmill.sources import files
from leafmill.sources.tables import open_table, sample_table

NOW = 1_700_000_000


@query("SELECT doc_id AS id, source AS book_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def lookup_by_keys(spark: SparkSession, d: str) -> DataFrame:
    asked = sample_table(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("id"))
    return catalog.by_keys(fx.unnumbered_pages(spark, d).select("id", "book_id"), asked, "id")


@query("SELECT id, title, author, total_pages FROM fx_books WHERE id = 'src3'", "fx_books")
def book_by_id(spark: SparkSession, d: str) -> DataFrame:
    return catalog.by_key(fx.books(spark, d), "id", "src3").select(
        "id", "title", "author", "total_pages"
    )


@query(
    """
    WITH stored AS (SELECT word, id, pos FROM fx_words),
    asked AS (SELECT DISTINCT lower(w) AS word FROM (
        SELECT unnest(regexp_split_to_array(text, '\\s+')) AS w FROM benchmark)
        WHERE strlen(w) > 2 AND regexp_full_match(w, '\\p{L}+'))
    SELECT word, id, pos FROM (SELECT s.*, row_number() OVER (PARTITION BY s.word ORDER BY s.id, s.pos) AS n
        FROM stored s JOIN asked USING (word)) WHERE n = 1""",
    "fx_words",
)
def word_lookup(spark: SparkSession, d: str) -> DataFrame:
    stored = fx.word_occurrences(fx.unnumbered_pages(spark, d), "ocr_text_plain", ["id"])
    stored = stored.select("word", "id", "pos")
    asked = fx.word_occurrences(sample_table(spark, d, "benchmark"), "text", []).select("word").distinct()
    return catalog.word_by_text(stored, asked, ["id", "pos"])


@query("SELECT id, page_number, ocr_markdown FROM fx_pages WHERE book_id = 'src7'", "fx_pages")
def pages_of_book(spark: SparkSession, d: str) -> DataFrame:
    return catalog.pages_of_book(fx.pages(spark, d, "src7"), "src7").select("id", "page_number", "ocr_markdown")


@query("SELECT id, book_id, page_number FROM fx_pages", "fx_pages")
def pages_sorted(spark: SparkSession, d: str) -> DataFrame:
    return fx.page_numbers(spark, d).orderBy("book_id", "page_number")


_ANNOTATION = ["id", "page_number", "annotation_type", "content", "color", "position_start", "user_note"]


@query(f"SELECT {', '.join(_ANNOTATION)} FROM fx_annotations WHERE book_id = 'src5'", "fx_annotations")
def annotations_of_book(spark: SparkSession, d: str) -> DataFrame:
    return catalog.annotations_of_book(fx.annotations(spark, d), "src5").select(*_ANNOTATION)


@query(
    f"SELECT {', '.join(_ANNOTATION)} FROM fx_annotations WHERE book_id = 'src5' AND annotation_type IN ('highlight', 'bookmark', 'note')",
    "fx_annotations",
)
def annotations_by_type(spark: SparkSession, d: str) -> DataFrame:
    return catalog.annotations_by_kind(fx.annotations(spark, d), "src5").select(*_ANNOTATION)


def _stored_words(spark: SparkSession, d: str) -> DataFrame:
    """One row per word and book, as if saved from the reader."""
    seen = fx.word_occurrences(fx.unnumbered_pages(spark, d), "ocr_text_plain", ["id", "book_id"])
    return seen.groupBy("word", "book_id").agg(F.min("id").alias("created_at")).select(
        "word", F.col("book_id").alias("source_book_id"),
        (F.char_length("word") > 6).alias("ai_generated"), "created_at", F.col("created_at").alias("id"),
    )


_STORED_WORDS = """WITH stored AS (SELECT word, book_id AS source_book_id, length(word) > 6 AS ai_generated,
    min(id) AS created_at FROM fx_words GROUP BY word, book_id)"""


@query(f"{_STORED_WORDS} SELECT word, ai_generated, created_at FROM stored WHERE source_book_id = 'src2'", "fx_words")
def words_of_book(spark: SparkSession, d: str) -> DataFrame:
    return catalog.words_of_book(_stored_words(spark, d), "src2").select("word", "ai_generated", "created_at")


@query(f"{_STORED_WORDS} SELECT word, source_book_id, created_at FROM stored WHERE ai_generated", "fx_words")
def generated_words(spark: SparkSession, d: str) -> DataFrame:
    return catalog.generated_words(_stored_words(spark, d)).select("word", "source_book_id", "created_at")


@query(f"{_STORED_WORDS} SELECT DISTINCT word FROM stored WHERE contains(word, 'tion') OR starts_with(word, 'the')", "fx_words")
def word_search_box(spark: SparkSession, d: str) -> DataFrame:
    stored = keep(_stored_words(spark, d).select("word").distinct())
    inside = catalog.words_matching(stored, "tion")
    leading = catalog.words_matching(stored, "the", prefix=True)
    return inside.unionByName(leading).distinct()


@query("SELECT id, title, author FROM fx_books", "fx_books")
def books_by_title(spark: SparkSession, d: str) -> DataFrame:
    return catalog.books_by_title(fx.books(spark, d)).select("id", "title", "author")


@query(
    """SELECT 'all' AS shelf, id, title FROM fx_books
       UNION ALL SELECT 'pdf', id, title FROM fx_books WHERE is_pdf
       UNION ALL SELECT 'physical', id, title FROM fx_books WHERE NOT is_pdf""",
    "fx_books",
)
def library_filter(spark: SparkSession, d: str) -> DataFrame:
    return catalog.shelves(fx.books(spark, d)).select("shelf", "id", "title")


@query(
    """SELECT id, pages_captured, total_pages,
              CASE WHEN total_pages > 0 THEN trunc((pages_captured::FLOAT / total_pages::FLOAT)
                   * 100::FLOAT)::INTEGER ELSE 0 END AS progress,
              is_pdf AND total_pages > 0 AND pages_captured < total_pages AS needs_conversion,
              CASE WHEN is_pdf AND total_pages > 0 AND pages_captured < total_pages THEN
                   CASE WHEN pages_captured > 0 THEN 'Resume Conversion' ELSE 'Convert' END END AS action
       FROM fx_books""",
    "fx_books",
)
def book_progress(spark: SparkSession, d: str) -> DataFrame:
    books = fx.books(spark, d)
    return books.select(
        "id", "pages_captured", "total_pages",
        catalog.progress_percent(books.pages_captured, books.total_pages).alias("progress"),
        catalog.needs_conversion(books).alias("needs_conversion"),
        catalog.conversion_action(books).alias("action"),
    )


@query("SELECT id, book_title, left(user_memo, 100) || '...' AS preview FROM fx_notes", "fx_notes")
def note_preview(spark: SparkSession, d: str) -> DataFrame:
    return fx.notes(spark, d).select("id", "book_title", preview(F.col("user_memo")).alias("preview"))


@query("SELECT id, book_title, page_number FROM fx_notes", "fx_notes")
def notes_newest_first(spark: SparkSession, d: str) -> DataFrame:
    return catalog.notes_newest_first(fx.notes(spark, d)).select("id", "book_title", "page_number")


@query("SELECT id, book_title, user_memo FROM fx_notes ORDER BY id DESC LIMIT 20", "fx_notes")
def notes_recent(spark: SparkSession, d: str) -> DataFrame:
    return catalog.notes_newest_first(fx.notes(spark, d), 20).select("id", "book_title", "user_memo")


@query(
    """SELECT event_id, greatest(least(trunc(value::FLOAT / (500::FLOAT / (k + 1)::FLOAT)
              + 1::FLOAT)::INTEGER, k + 1), 1) AS page
       FROM (SELECT event_id, value, regexp_extract(props, '"k": (\\d+)', 1)::INTEGER AS k FROM events)"""
)
def scroll_page(spark: SparkSession, d: str) -> DataFrame:
    pages = fx.props_k() + 1
    return sample_table(spark, d, "events").select(
        "event_id", catalog.page_at_scroll(F.col("value"), F.lit(500), pages).alias("page")
    )


@query(
    """SELECT a.id, a.book_id, a.page_number,
              coalesce(a.page_number >= 1 AND a.page_number <= b.total_pages, false) AS valid
       FROM fx_annotations a LEFT JOIN fx_books b ON b.id = a.book_id""",
    "fx_annotations fx_books",
)
def page_ref_valid(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.annotations(spark, d).select("id", "book_id", "page_number")
    checked = catalog.check_page_refs(rows, fx.books(spark, d))
    return checked.select("id", "book_id", "page_number", "valid")


_TITLE = r"<title>([^<]*)</title>"


@query(
    """SELECT page_id, coalesce(regexp_extract(html, '<title>([^<]*)</title>', 1), '') <> ''
              AND coalesce(regexp_extract(html, '<meta name="author" content="([^"]*)"', 1), '') <> '' AS valid
       FROM pages"""
)
def required_fields(spark: SparkSession, d: str) -> DataFrame:
    forms = sample_table(spark, d, "pages").select(
        "page_id",
        F.regexp_extract("html", _TITLE, 1).alias("title"),
        F.regexp_extract("html", r'<meta name="author" content="([^"]*)"', 1).alias("author"),
    )
    return forms.select("page_id", catalog.required_present("title", "author").alias("valid"))


@query(
    """SELECT id, annotation_type,
              CASE WHEN lower(annotation_type) IN ('highlight', 'bookmark', 'note')
                   THEN lower(annotation_type) END AS parsed,
              CASE WHEN annotation_type NOT IN ('highlight', 'bookmark', 'note')
                   THEN 'unknown annotation type' END AS reject_reason
       FROM fx_annotations""",
    "fx_annotations",
)
def annotation_parse(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.annotations(spark, d)
    rules = [("unknown annotation type", F.col("annotation_type").isin(*ANNOTATION_TYPES))]
    return rows.select(
        "id", "annotation_type",
        catalog.annotation_type(F.col("annotation_type")).alias("parsed"),
        audits.first_broken_rule(rules).alias("reject_reason"),
    )


@query(
    """SELECT id, annotation_type, 'unknown annotation type' AS reject_reason FROM fx_annotations
       WHERE annotation_type NOT IN ('highlight', 'bookmark', 'note')""",
    "fx_annotations",
)
def annotation_reject(spark: SparkSession, d: str) -> DataFrame:
    _, rejected = writes.accept_rows(fx.annotations(spark, d), "annotations")
    return rejected.select("id", "annotation_type", "reject_reason")


@query(
    """SELECT id, annotation_type = 'highlight' AS is_highlight, annotation_type = 'bookmark' AS is_bookmark,
              annotation_type = 'note' AS is_note FROM fx_annotations""",
    "fx_annotations",
)
def annotation_flags(spark: SparkSession, d: str) -> DataFrame:
    flagged = catalog.type_flags(fx.annotations(spark, d))
    return flagged.select("id", "is_highlight", "is_bookmark", "is_note")


@query(
    """SELECT signal_id, count(*) AS samples, round(count(*) / 16000.0::DOUBLE, 6) AS seconds,
              CASE WHEN count(*) < 64 THEN 'too short' WHEN count(*) / 16000.0::DOUBLE > 0.005
                   THEN 'too long' END AS reject_reason
       FROM fx_signal GROUP BY signal_id""",
    "fx_signal",
)
def audio_duration(spark: SparkSession, d: str) -> DataFrame:
    samples = sample_table(spark, d, "events").select(F.col("user_id").alias("signal_id"))
    sizes = samples.groupBy("signal_id").agg(F.count(F.lit(1)).alias("samples"))
    checked = with_reject_reason(sizes, 64, limit=0.005)
    return checked.withColumn("seconds", F.round("seconds", 6))


@query(
    """SELECT p_partkey, CASE WHEN greatest(w, h) > 1024 THEN
                  trunc(w::FLOAT * (1024::FLOAT / greatest(w, h)::FLOAT))::INTEGER ELSE w END AS width,
              CASE WHEN greatest(w, h) > 1024 THEN
                  trunc(h::FLOAT * (1024::FLOAT / greatest(w, h)::FLOAT))::INTEGER ELSE h END AS height
       FROM (SELECT p_partkey, p_size * 67 AS w, floor(p_retailprice)::INTEGER AS h FROM part)"""
)
def resize_plan(spark: SparkSession, d: str) -> DataFrame:
    images = sample_table(spark, d, "part").select(
        "p_partkey", (F.col("p_size") * 67).alias("w"), F.floor("p_retailprice").cast("int").alias("h")
    )
    w, h = F.col("w"), F.col("h")
    return images.select(
        "p_partkey", resized(w, w, h).alias("width"), resized(h, w, h).alias("height")
    )


@query(
    """SELECT b.id AS book_id, b.title, b.total_pages, p.id AS page_id, p.page_number
       FROM (SELECT * FROM fx_books UNION ALL
             SELECT s_name, s_name, 'none', 0, 0, false, NULL, 0 FROM supplier) b
       LEFT JOIN fx_pages p ON p.book_id = b.id""",
    "fx_books fx_pages",
)
def book_pages_joined(spark: SparkSession, d: str) -> DataFrame:
    name = F.col("s_name")
    unread = sample_table(spark, d, "supplier").select(
        name.alias("id"), name.alias("title"), F.lit("none").alias("author"), F.lit(0).alias("total_pages")
    )
    shelf = fx.books(spark, d).select("id", "title", "author", "total_pages").unionByName(unread)
    joined = catalog.books_with_pages(shelf, fx.page_numbers(spark, d).withColumnRenamed("id", "page_id"))
    return joined.select("book_id", "title", "total_pages", "page_id", "page_number")


@query(
    """SELECT book_id, page_number, annotation_type, content, color, user_note, position_start
       FROM fx_annotations WHERE annotation_type IN ('highlight', 'bookmark', 'note')""",
    "fx_annotations",
)
def annotations_union(spark: SparkSession, d: str) -> DataFrame:
    table = fx.annotations(spark, d)
    common = ["book_id", "page_number", "content"]
    own = {"highlight": ["color", "position_start"], "bookmark": [], "note": ["user_note", "position_start"]}
    return catalog.annotation_feed(table, common, own).select(
        "book_id", "page_number", "annotation_type", "content", "color", "user_note", "position_start"
    )


@query("SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def unique_violations(spark: SparkSession, d: str) -> DataFrame:
    return audits.unique_violations(sample_table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    """WITH target AS (SELECT DISTINCT book_id, last_processed_page FROM fx_progress WHERE status = 'completed'),
       batch AS (SELECT *, min(seq) OVER (PARTITION BY book_id, last_processed_page) AS first
                 FROM fx_progress WHERE status = 'processing')
       SELECT b.book_id, b.last_processed_page AS page_number, b.seq,
              CASE WHEN t.book_id IS NOT NULL THEN 'key exists' WHEN b.seq <> b.first
                   THEN 'repeated in batch' END AS reject_reason
       FROM batch b LEFT JOIN target t USING (book_id, last_processed_page)""",
    "fx_progress",
)
def insert_unique(spark: SparkSession, d: str) -> DataFrame:
    log = fx.progress_log(spark, d).select(
        "book_id", F.col("last_processed_page").alias("page_number"), "seq", "status"
    )
    stored, batch = log.filter("status = 'completed'"), log.filter("status = 'processing'")
    accepted, rejected = writes.accept_pages(batch, stored, "seq")
    both = accepted.unionByName(rejected, allowMissingColumns=True)
    return both.select("book_id", "page_number", "seq", "reject_reason")


@query(
    """SELECT 'annotations' AS child, id::VARCHAR AS row_id, book_id AS parent_id FROM fx_annotations
       WHERE book_id NOT IN (SELECT id FROM fx_books)
       UNION ALL SELECT 'pages', id::VARCHAR, book_id FROM fx_pages WHERE book_id NOT IN (SELECT id FROM fx_books)
       UNION ALL SELECT 'progress', seq::VARCHAR, book_id::VARCHAR FROM fx_progress
       UNION ALL SELECT 'words', id::VARCHAR || '/' || pos::VARCHAR, book_id FROM fx_words
                 WHERE book_id NOT IN (SELECT id FROM fx_books)""",
    "fx_annotations fx_books fx_pages fx_progress fx_words",
)
def fk_orphans(spark: SparkSession, d: str) -> DataFrame:
    pages = fx.unnumbered_pages(spark, d)
    occurrences = fx.word_occurrences(pages, "ocr_text_plain", ["id", "book_id"])
    children = [
        ("annotations", fx.annotations(spark, d), "id", "book_id"),
        ("pages", pages, "id", "book_id"),
        ("progress", fx.progress_log(spark, d), "seq", "book_id"),
        (
            "words",
            occurrences.select(F.concat_ws("/", "id", "pos").alias("row_id"), "book_id"),
            "row_id", "book_id",
        ),
    ]
    return audits.foreign_key_orphans(children, fx.books(spark, d), "id")


@query(
    """SELECT 'lineitem' AS child, l_orderkey::VARCHAR || '/' || l_linenumber::VARCHAR AS row_id,
              l_partkey::VARCHAR AS parent_id FROM lineitem
       WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)"""
)
def fk_orphans_parts(spark: SparkSession, d: str) -> DataFrame:
    lines = sample_table(spark, d, "lineitem").select(
        F.concat_ws("/", "l_orderkey", "l_linenumber").alias("row_id"), "l_partkey"
    )
    parts = sample_table(spark, d, "part").filter("p_size > 25")
    return audits.foreign_key_orphans([("lineitem", lines, "row_id", "l_partkey")], parts, "p_partkey")


@query(
    f"""SELECT s_name AS id, s_name AS title, 'unknown' AS author, NULL::VARCHAR AS cover_path,
               0 AS pages_captured, NULL::INTEGER AS total_pages, NULL::BIGINT AS last_opened_at,
               {NOW}::BIGINT AS created_at, {NOW}::BIGINT AS updated_at, false AS is_pdf,
               NULL::VARCHAR AS pdf_path FROM supplier"""
)
def insert_defaults(spark: SparkSession, d: str) -> DataFrame:
    given = sample_table(spark, d, "supplier").select(
        F.col("s_name").alias("id"), F.col("s_name").alias("title"), F.lit("unknown").alias("author")
    )
    return writes.with_defaults(given, "books", F.lit(NOW))


def _stored(spark: SparkSession, rows: DataFrame, table: str) -> DataFrame:
    """``rows`` appended to a new catalog in two steps, and the table opened again by its schema."""
    root = fresh_path(spark, "catalog")
    whole = writes.with_defaults(rows, table, F.lit(NOW))
    for half in (0, 1):
        writes.append(whole.where(F.pmod("id", F.lit(2)) == half), root, table)
    return open_table(spark, root, table)


@query(
    f"SELECT id, page_number, ocr_text_plain, {NOW}::BIGINT AS created_at FROM fx_pages WHERE book_id = 'src7'",
    "fx_pages",
)
def stored_pages(spark: SparkSession, d: str) -> DataFrame:
    """One book of the stored pages, from its own partition."""
    given = fx.pages(spark, d).withColumn("image_path", F.lit("/pages"))
    stored = catalog.pages_of_book(_stored(spark, given, "book_pages"), "src7")
    return stored.select("id", "page_number", "ocr_text_plain", "created_at")


@query(
    """SELECT id, page_number, annotation_type, color FROM fx_annotations
       WHERE book_id = 'src3' AND annotation_type IN ('highlight', 'bookmark', 'note')""",
    "fx_annotations",
)
def stored_annotations(spark: SparkSession, d: str) -> DataFrame:
    given, _ = writes.accept_rows(fx.annotations(spark, d), "annotations")
    stored = catalog.annotations_of_book(_stored(spark, given, "annotations"), "src3")
    return stored.select("id", "page_number", "annotation_type", "color")


@query("SELECT id, book_title, page_number, user_memo FROM fx_notes", "fx_notes")
def stored_notes(spark: SparkSession, d: str) -> DataFrame:
    return _stored(spark, fx.notes(spark, d), "sticky_notes").select("id", "book_title", "page_number", "user_memo")


@query(
    """SELECT row_number() OVER (ORDER BY p_partkey) AS id, p_name AS word, false AS ai_generated, p_size AS source_page FROM part"""
)
def stored_words(spark: SparkSession, d: str) -> DataFrame:
    parts = sample_table(spark, d, "part").select(
        "p_partkey", F.col("p_name").alias("word"), F.col("p_size").alias("source_page")
    )
    given = writes.next_ids(parts, spark.createDataFrame([], "id long"), [F.col("p_partkey")])
    return _stored(spark, given, "words").select("id", "word", "ai_generated", "source_page")


@query(
    """SELECT conv_id, turn, (SELECT max(doc_id) FROM documents)
              + row_number() OVER (ORDER BY conv_id, turn) AS id FROM conversations"""
)
def sequential_ids(spark: SparkSession, d: str) -> DataFrame:
    turns = sample_table(spark, d, "conversations").select("conv_id", "turn")
    stored = sample_table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    return writes.next_ids(turns, stored, [F.col("conv_id"), F.col("turn")])


@query("SELECT page_id, substring(md5(url || chr(31) || page_id::VARCHAR), 1, 16) AS id FROM pages")
def hash_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = sample_table(spark, d, "pages").select("page_id", "url")
    return writes.with_hash_ids(rows, "url", "page_id").select("page_id", "id")


@query(
    """SELECT url AS source_path, 'pdfs/' || substring(md5(url), 1, 16) || '.pdf' AS target_path,
              coalesce(nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), ''),
                       nullif(regexp_extract(url, '([^/]+?)(\\.[^./]*)?$', 1), ''), 'Unknown') AS title
       FROM pages"""
)
def import_manifest(spark: SparkSession, d: str) -> DataFrame:
    pages = sample_table(spark, d, "pages")
    return files.import_manifest(pages, F.col("url"), F.regexp_extract("html", _TITLE, 1))


@query(
    """SELECT url, coalesce(nullif(regexp_extract(url, '([^/]+?)(\\.[^./]*)?$', 1), ''), 'Unknown') AS title
       FROM pages"""
)
def title_from_path(spark: SparkSession, d: str) -> DataFrame:
    pages = sample_table(spark, d, "pages")
    return files.import_manifest(pages, F.col("url"), F.lit("")).select(
        F.col("source_path").alias("url"), "title"
    )


@query(
    f"""SELECT id, 'pages/' || book_id || '/{NOW}_'
               || substring(md5(book_id || chr(31) || '{NOW}' || chr(31) || id::VARCHAR), 1, 16) || '.jpg' AS page_path,
               'images/cover_' || substring(md5('cover' || chr(31) || id::VARCHAR), 1, 16) || '.bin' AS cover_path
        FROM fx_pages""",
    "fx_pages",
)
def page_image_paths(spark: SparkSession, d: str) -> DataFrame:
    pages = fx.unnumbered_pages(spark, d)
    now = F.lit(NOW).cast("long")
    return pages.select(
        "id",
        files.page_image_path(F.col("book_id"), now, F.col("id")).alias("page_path"),
        files.image_path(F.lit("cover"), F.col("id")).alias("cover_path"),
    )


@query(
    """SELECT doc_id, unnest(lines) AS token, unnest(range(len(lines)))::INTEGER AS line
       FROM (SELECT doc_id, string_split(regexp_replace(text, '\\n\\z', ''), chr(10)) AS lines
             FROM documents WHERE text <> '')"""
)
def dictionary_lines(spark: SparkSession, d: str) -> DataFrame:
    return files.text_lines(sample_table(spark, d, "documents"), ["doc_id"], F.col("text"))


@query(
    """WITH files AS (SELECT DISTINCT '/pdfs/src' || (s_suppkey % 30)::VARCHAR || '.pdf' AS path FROM supplier),
       named AS (SELECT pdf_path AS path FROM fx_books WHERE pdf_path IS NOT NULL)
       SELECT path, 'unreferenced file' AS finding, NULL::VARCHAR AS origin FROM files
       WHERE path NOT IN (SELECT path FROM named)
       UNION ALL SELECT path, 'missing file', 'books.pdf_path' FROM named WHERE path NOT IN (SELECT path FROM files)""",
    "fx_books",
)
def orphan_files(spark: SparkSession, d: str) -> DataFrame:
    number = (F.col("s_suppkey") % 30).cast("string")
    present = sample_table(spark, d, "supplier").select(
        F.concat(F.lit("/pdfs/src"), number, F.lit(".pdf")).alias("path")
    ).distinct()
    named = fx.books(spark, d).select(F.col("pdf_path").alias("path"), F.lit("books.pdf_path").alias("origin"))
    return files.reconcile(present, named)


@query("SELECT id, title, author, total_pages, pages_captured, is_pdf, pdf_path, created_at, true AS same FROM fx_books", "fx_books")
def book_json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    books = fx.books(spark, d)
    written = books.select(docs.to_document(books).alias("json"))
    read = docs.from_document(written, "json", books.schema).filter("reject_reason is null")
    again = read.select("json", "document.*")
    return again.withColumn("same", F.col("json") == docs.to_document(books)).drop("json")


@query(
    """SELECT user_id, timestamp, current_route, scroll_position FROM (
         SELECT user_id, event_id AS timestamp, '/' || event_type AS current_route, value AS scroll_position,
                row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n
         FROM events WHERE event_type <> 'error') WHERE n = 1"""
)
def app_state_last(spark: SparkSession, d: str) -> DataFrame:
    events = sample_table(spark, d, "events")
    state = F.to_json(
        F.struct(
            F.concat(F.lit("/"), "event_type").alias("current_route"),
            F.col("value").alias("scroll_position"),
            F.col("event_id").alias("timestamp"),
        )
    )
    broken = F.when(F.col("event_type") == "error", F.concat(F.lit("broken "), state)).otherwise(state)
    return docs.last_states(events.select("user_id", broken.alias("state")), "user_id", "state")


_PATCH = ["content", "color", "position_start"]
_FOLDED = """folded AS (SELECT id, arg_max(content, (ts, seq)) FILTER (content IS NOT NULL) AS content,
    arg_max(color, (ts, seq)) FILTER (color IS NOT NULL) AS color,
    arg_max(position_start, (ts, seq)) FILTER (position_start IS NOT NULL) AS position_start
    FROM fx_patches GROUP BY id)"""


def _folded(spark: SparkSession, d: str) -> DataFrame:
    return merge.fold_patches(fx.patches(spark, d), "id", _PATCH, ["ts", "seq"])


@query(f"WITH {_FOLDED} SELECT id, content, color, position_start FROM folded", "fx_patches")
def patch_fold(spark: SparkSession, d: str) -> DataFrame:
    return _folded(spark, d)


@query(
    f"""WITH {_FOLDED} SELECT t.id, coalesce(f.content, t.content) AS content, coalesce(f.color, t.color) AS color,
        coalesce(f.position_start, t.position_start) AS position_start,
        CASE WHEN f.id IS NOT NULL THEN {NOW}::BIGINT ELSE t.updated_at END AS updated_at
        FROM fx_patch_target t LEFT JOIN folded f ON f.id = t.id""",
    "fx_patches fx_patch_target",
)
def patch_apply(spark: SparkSession, d: str) -> DataFrame:
    return merge.apply_patches(
        fx.patch_targets(spark, d), _folded(spark, d), "id", _PATCH,
        ("updated_at", F.lit(NOW).cast("long")),
    )


@query(
    f"""WITH {_FOLDED} SELECT a.id, a.page_number, a.annotation_type, coalesce(f.content, a.content) AS content,
        coalesce(f.color, a.color) AS color, coalesce(f.position_start, a.position_start) AS position_start
        FROM fx_annotations a LEFT JOIN folded f ON f.id = a.id""",
    "fx_patches fx_annotations",
)
def annotation_patch_apply(spark: SparkSession, d: str) -> DataFrame:
    patched = merge.apply_patches(fx.annotations(spark, d), _folded(spark, d), "id", _PATCH)
    return patched.select("id", "page_number", "annotation_type", *_PATCH)


@query(
    f"""WITH {_FOLDED} SELECT t.id, CASE WHEN f.id IS NOT NULL THEN f.content ELSE t.content END AS content,
        CASE WHEN f.id IS NOT NULL THEN f.color ELSE t.color END AS color,
        CASE WHEN f.id IS NOT NULL THEN f.position_start ELSE t.position_start END AS position_start, t.updated_at
        FROM fx_patch_target t LEFT JOIN folded f ON f.id = t.id""",
    "fx_patches fx_patch_target",
)
def replace_apply(spark: SparkSession, d: str) -> DataFrame:
    return merge.replace_rows(fx.patch_targets(spark, d), _folded(spark, d), "id", _PATCH)


_LATEST = """latest AS (SELECT book_id, last_processed_page, total_pages, status, updated_at, seq FROM (
    SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY updated_at DESC, seq DESC) AS n FROM fx_progress)
    WHERE n = 1)"""


def _latest(spark: SparkSession, d: str) -> DataFrame:
    return merge.fold_latest(fx.progress_log(spark, d), "book_id", ["updated_at", "seq"])


@query(f"WITH {_LATEST} SELECT * FROM latest", "fx_progress")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    return _latest(spark, d)


def _stored_progress(spark: SparkSession, d: str) -> DataFrame:
    return _latest(spark, d).select(
        F.col("book_id").cast("string").alias("book_id"), "last_processed_page", "total_pages", "status",
        F.col("seq").alias("updated_at"),
    )


@query(
    f"""WITH {_LATEST} SELECT l.book_id::VARCHAR AS book_id, l.last_processed_page, l.total_pages, l.status,
               l.seq AS updated_at FROM latest l
        WHERE l.book_id::VARCHAR NOT IN (SELECT c_custkey::VARCHAR FROM customer WHERE c_nationkey < 10)
        UNION ALL SELECT c_custkey::VARCHAR, 0, c_nationkey, 'pending', {NOW} FROM customer WHERE c_nationkey < 10""",
    "fx_progress",
)
def progress_reset(spark: SparkSession, d: str) -> DataFrame:
    started = sample_table(spark, d, "customer").filter("c_nationkey < 10").select(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_nationkey").alias("total_pages")
    )
    return merge.reset_progress(_stored_progress(spark, d), started, F.lit(NOW).cast("long"))


@query(
    f"""WITH {_LATEST} SELECT l.book_id::VARCHAR AS book_id,
               CASE WHEN c.c_custkey IS NOT NULL THEN c.c_nationkey ELSE l.last_processed_page END AS last_processed_page,
               l.total_pages, CASE WHEN c.c_custkey IS NOT NULL THEN 'processing' ELSE l.status END AS status,
               CASE WHEN c.c_custkey IS NOT NULL THEN {NOW} ELSE l.seq END AS updated_at
        FROM latest l LEFT JOIN customer c ON c.c_custkey = l.book_id AND c.c_nationkey < 10""",
    "fx_progress",
)
def progress_update(spark: SparkSession, d: str) -> DataFrame:
    updates = sample_table(spark, d, "customer").filter("c_nationkey < 10").select(
        F.col("c_custkey").cast("string").alias("book_id"),
        F.col("c_nationkey").alias("last_processed_page"),
        F.lit("processing").alias("status"),
    )
    return merge.update_progress(_stored_progress(spark, d), updates, F.lit(NOW).cast("long"))


@query(
    f"""SELECT d.doc_id AS id, CASE WHEN l.doc_id IS NOT NULL THEN 'quality ' || l.quality::VARCHAR END AS definition,
               coalesce(l.toxic = 1, false) AS ai_generated,
               CASE WHEN l.doc_id IS NOT NULL THEN {NOW} ELSE 0 END::BIGINT AS updated_at
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""
)
def definition_update(spark: SparkSession, d: str) -> DataFrame:
    stored = sample_table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("definition"),
        F.lit(False).alias("ai_generated"), F.lit(0).cast("long").alias("updated_at"),
    )
    made = sample_table(spark, d, "labels").select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("definition"),
        (F.col("toxic") == 1).alias("ai_generated"),
    )
    return merge.update_definitions(stored, made, F.lit(NOW).cast("long"))


@query(
    """SELECT d.doc_id AS id, CASE WHEN l.doc_id IS NULL THEN 'images/old.bin'
              WHEN l.quality = 1 THEN 'images/cover_' || d.doc_id::VARCHAR || '.bin' END AS cover_path
       FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""
)
def cover_update(spark: SparkSession, d: str) -> DataFrame:
    stored = sample_table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.lit("images/old.bin").alias("cover_path")
    )
    path = F.concat(F.lit("images/cover_"), F.col("doc_id").cast("string"), F.lit(".bin"))
    covers = sample_table(spark, d, "labels").select(
        F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, path).alias("cover_path")
    )
    return merge.set_covers(stored, covers)


@query(
    "SELECT id, content, color FROM fx_patch_target WHERE id NOT IN (SELECT id FROM fx_patches)",
    "fx_patches fx_patch_target",
)
def delete_by_key(spark: SparkSession, d: str) -> DataFrame:
    kept = merge.delete_keys(fx.patch_targets(spark, d), fx.patches(spark, d), "id")
    return kept.select("id", "content", "color")


@query(
    """SELECT id, book_id, annotation_type FROM fx_annotations
       WHERE book_id NOT IN (SELECT id FROM fx_books WHERE is_pdf)""",
    "fx_annotations fx_books",
)
def delete_by_book(spark: SparkSession, d: str) -> DataFrame:
    gone = fx.books(spark, d).filter("is_pdf").select(F.col("id").alias("book_id"))
    kept = merge.delete_keys(fx.annotations(spark, d), gone, "book_id")
    return kept.select("id", "book_id", "annotation_type")


@query(
    """SELECT b.id AS book_id, count(a.id) AS affected FROM fx_books b
       LEFT JOIN fx_annotations a ON a.book_id = b.id WHERE b.is_pdf GROUP BY b.id""",
    "fx_annotations fx_books",
)
def delete_by_book_counts(spark: SparkSession, d: str) -> DataFrame:
    gone = fx.books(spark, d).filter("is_pdf").select(F.col("id").alias("book_id"))
    return merge.affected_by_book(fx.annotations(spark, d), gone)


@query(
    "SELECT count(*) AS affected FROM fx_patch_target WHERE id IN (SELECT id FROM fx_patches)",
    "fx_patches fx_patch_target",
)
def affected_rows(spark: SparkSession, d: str) -> DataFrame:
    return merge.affected(fx.patch_targets(spark, d), fx.patches(spark, d), "id")


_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) > 0 AS filled FROM {t}" for t in _TABLES))
def file_listing(spark: SparkSession, d: str) -> DataFrame:
    """The stored tables by the files that hold them, a single file or a folder of them each."""
    found = files.find_files(spark, d, r"/[a-z]+\.parquet(/[^/]*\.parquet)?$")
    return found.groupBy(F.regexp_extract("path", r"/([a-z]+)\.parquet", 1).alias("name")).agg(
        F.bool_or(F.col("length") > 0).alias("filled")
    )


@query(
    """SELECT event_id, epoch(date_trunc('second', ts))::BIGINT AS seconds,
              strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS stamp FROM events"""
)
def epoch_stamps(spark: SparkSession, d: str) -> DataFrame:
    """Event times as the catalog stores them: whole seconds, and text."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    seconds = clock.epoch_seconds(F.col("ts").cast("timestamp"))
    return sample_table(spark, d, "events").select("event_id", seconds.alias("seconds")).withColumn(
        "stamp", clock.stamp(F.col("seconds"))
    )


_NOTED = ["id", "book_id", "annotation_type", "content", "color", "user_note"]


@query(
    """WITH upserted AS (
        SELECT id, book_id, annotation_type, CASE WHEN id % 4 = 0 THEN 'edited' ELSE content END AS content, color, user_note FROM fx_annotations
        UNION ALL SELECT id + 1000000000, book_id, 'bookmark', content, NULL, NULL FROM fx_annotations WHERE id % 50 = 0)
       SELECT id, book_id, annotation_type, content, CASE WHEN id % 6 = 0 THEN 'green' ELSE color END AS color,
           CASE WHEN id % 6 = 0 AND id % 9 = 0 THEN 'seen again' WHEN id % 6 = 0 THEN 'seen' ELSE user_note END AS user_note
       FROM upserted WHERE id % 10 <> 3""",
    "fx_annotations",
)
def stored_changes(spark: SparkSession, d: str) -> DataFrame:
    """A stored table after an upsert with new rows, a folded log of patches, and a delete; then read back."""
    rows = fx.annotations(spark, d).select(_NOTED)
    table = StoredTable(spark, fresh_path(spark, "annotations"), rows.schema, "id", buckets=16).create(rows)
    edited = rows.where("id % 4 = 0").withColumn("content", F.lit("edited"))
    none = F.lit(None).cast("string")
    added = rows.where("id % 50 = 0").select(
        (F.col("id") + 1_000_000_000).alias("id"), "book_id", F.lit("bookmark").alias("annotation_type"), "content",
        none.alias("color"), none.alias("user_note"),
    )
    table.upsert(edited.unionByName(added), 1)
    ids = table.read().where("id % 6 = 0").select("id")
    log = (
        ids.select("id", F.lit(1).alias("seq"), F.lit("green").alias("color"), F.lit("seen").alias("user_note"))
        .unionByName(ids.select("id", F.lit(2).alias("seq"), none.alias("color"), F.when(F.col("id") % 9 == 0, "seen again").alias("user_note")))
    )
    table.patch(merge.fold_patches(log, "id", ["color", "user_note"], ["seq"]), ["color", "user_note"], 2)
    table.delete(table.read().where("id % 10 = 3").select("id"), 3)
    return table.read()
