"""Fixed schemas of the catalog tables, and their column defaults."""

from __future__ import annotations

from pyspark.sql import types as T

ANNOTATION_TYPES = ("highlight", "bookmark", "note")
PROGRESS_STATUSES = ("pending", "processing", "completed", "failed")


def _table(**columns: tuple[T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, null) for n, (t, null) in columns.items()])


_TEXT, _REQUIRED_TEXT = (T.StringType(), True), (T.StringType(), False)
_INT, _REQUIRED_INT = (T.IntegerType(), True), (T.IntegerType(), False)
_LONG, _REQUIRED_LONG = (T.LongType(), True), (T.LongType(), False)
_FLAG, _DOUBLE = (T.BooleanType(), True), (T.DoubleType(), True)
_TIME = (T.TimestampType(), True)

TABLES = {
    "sticky_notes": _table(
        id=_REQUIRED_LONG, created_at=_TIME, updated_at=_TIME, image_path=_TEXT,
        ocr_markdown=_TEXT, voice_transcript=_TEXT, book_title=_TEXT, page_number=_INT,
        user_memo=_TEXT, tags=_TEXT, ocr_text_plain=_TEXT,
    ),
    "books": _table(
        id=_REQUIRED_TEXT, title=_REQUIRED_TEXT, author=_REQUIRED_TEXT, cover_path=_TEXT,
        pages_captured=_INT, total_pages=_INT, last_opened_at=_LONG, created_at=_REQUIRED_LONG,
        updated_at=_REQUIRED_LONG, is_pdf=_FLAG, pdf_path=_TEXT,
    ),
    "processing_progress": _table(
        book_id=_REQUIRED_TEXT, last_processed_page=_INT, total_pages=_INT, status=_TEXT,
        updated_at=_REQUIRED_LONG,
    ),
    "book_pages": _table(
        id=_REQUIRED_LONG, book_id=_REQUIRED_TEXT, page_number=_REQUIRED_INT,
        image_path=_REQUIRED_TEXT, ocr_markdown=_REQUIRED_TEXT, ocr_text_plain=_REQUIRED_TEXT,
        confidence=_DOUBLE, created_at=_REQUIRED_LONG,
    ),
    "vocabulary": _table(
        id=_REQUIRED_LONG, word=_REQUIRED_TEXT, meaning=_TEXT, example_sentence=_TEXT,
        source_book=_TEXT, source_page=_INT, tags=_TEXT, created_at=_TIME, review_count=_INT,
        last_reviewed_at=_TIME,
    ),
    "words": _table(
        id=_REQUIRED_LONG, word=_REQUIRED_TEXT, definition=_TEXT, ai_generated=_FLAG,
        source_book_id=_TEXT, source_page=_INT, context_text=_TEXT, created_at=_REQUIRED_LONG,
        updated_at=_REQUIRED_LONG,
    ),
    "annotations": _table(
        id=_REQUIRED_LONG, book_id=_REQUIRED_TEXT, page_number=_REQUIRED_INT,
        annotation_type=_REQUIRED_TEXT, content=_REQUIRED_TEXT, color=_TEXT, position_start=_INT,
        position_end=_INT, user_note=_TEXT, created_at=_REQUIRED_LONG, updated_at=_REQUIRED_LONG,
    ),
}

# Values a new row takes where the input leaves a column out or null.
DEFAULTS = {
    "sticky_notes": {},
    "books": {"pages_captured": 0, "is_pdf": False},
    "processing_progress": {"last_processed_page": 0, "status": "pending"},
    "book_pages": {},
    "vocabulary": {"review_count": 0},
    "words": {"ai_generated": False},
    "annotations": {},  # a colour that is null stays null
}

# Columns stamped with the insert time.
STAMPS = {
    "sticky_notes": ("created_at", "updated_at"),
    "books": ("created_at", "updated_at"),
    "processing_progress": ("updated_at",),
    "book_pages": ("created_at",),
    "vocabulary": ("created_at",),
    "words": ("created_at", "updated_at"),
    "annotations": ("created_at", "updated_at"),
}

# The column tables are partitioned by on disk.
PARTITIONS = {"book_pages": "book_id", "annotations": "book_id"}

# A reader's saved application state.
APP_STATE = T.StructType(
    [
        T.StructField("current_route", T.StringType()),
        T.StructField("scroll_position", T.DoubleType()),
        T.StructField("timestamp", T.LongType()),
    ]
)
