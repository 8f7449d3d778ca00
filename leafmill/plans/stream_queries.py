"""Streaming queries over the event and conversation files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.operators import search
from leafmill.plans import fixtures as fx
from leafmill.plans.registry import query
from leafmill.operators.text_index import StoredIndex
from leafmill.plans.search_queries import NOTE_COLUMNS, _bm25, _tokens
from leafmill.session import fresh_path
from leafmill.sources.tables import sample_table
from leafmill.streaming import events as stream
from leafmill.streaming.notes import ingest_notes, maintain_index
from leafmill.streaming.partials import StoredPartials, fold_sessions, fold_windows, maintain, session_partial, window_partial
from leafmill.streaming.progress import maintain_progress
from leafmill.streaming.windows import sessions, window_counts


def _events(spark: SparkSession, d: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return stream.event_stream(spark, d)


def _time(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


@query(
    """SELECT book_id, max(last_processed_page) AS last_processed_page, arg_max(status, seq) AS status, max(seq) AS newest_event
       FROM fx_progress GROUP BY book_id""",
    "fx_progress",
)
def page_state_stream(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    status = (
        F.when(kind == "view", "processing").when(kind == "purchase", "completed")
        .when(kind == "error", "failed").otherwise("pending")
    )
    pages = _events(spark, d).select(
        F.col("user_id").alias("book_id"), fx.props_k().alias("page"), status.alias("status"),
        "ts", "event_id",
    )
    return maintain_progress(pages).select(
        "book_id", "last_processed_page", "status", F.col("newest.event_id").alias("newest_event")
    )


@query(
    """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, user_id, count(*) AS events,
              round(sum(value), 4) AS value FROM events GROUP BY ALL"""
)
def window_stream(spark: SparkSession, d: str) -> DataFrame:
    counts = window_counts(_events(spark, d), "1 day")
    stored = stream.stored_result(counts, "complete")
    return stored.select(
        _time("window.start").alias("start"), "user_id", "events", F.round("value", 4).alias("value")
    )


@query(
    """WITH starts AS (SELECT *, unnest([time_bucket(INTERVAL '12 hours', ts), time_bucket(INTERVAL '12 hours', ts) - INTERVAL '12 hours']) AS s FROM events)
       SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS events, round(sum(value), 4) AS value
       FROM starts GROUP BY s, event_type"""
)
def sliding_window_stream(spark: SparkSession, d: str) -> DataFrame:
    counts = window_counts(_events(spark, d), "1 day", "12 hours", key="event_type")
    stored = stream.stored_result(counts, "complete")
    return stored.select(
        _time("window.start").alias("start"), "event_type", "events", F.round("value", 4).alias("value")
    )


@query(
    """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, user_id, count(*) AS events,
              round(sum(value), 4) AS value FROM events GROUP BY date_trunc('day', ts), user_id
       HAVING date_trunc('day', ts) + INTERVAL '1 day' <= (SELECT max(ts) FROM events) - INTERVAL '1 hour'"""
)
def window_final_stream(spark: SparkSession, d: str) -> DataFrame:
    """Windows that are closed: the watermark, an hour behind the newest event, has passed their end.

    Closed windows leave the state; those still open come with a later run.
    """
    stored = stream.stored_result(window_counts(_events(spark, d), "1 day"), "append")
    return stored.select(
        _time("window.start").alias("start"), "user_id", "events", F.round("value", 4).alias("value")
    )


@query(
    """WITH marked AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '6 hours'
           THEN 0 ELSE 1 END AS opens FROM events),
       numbered AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM marked)
       SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS events,
              min(regexp_extract(props, '"k": (\\d+)', 1)::INTEGER) AS first_page,
              max(regexp_extract(props, '"k": (\\d+)', 1)::INTEGER) AS last_page
       FROM numbered GROUP BY user_id, session"""
)
def session_stream(spark: SparkSession, d: str) -> DataFrame:
    spark.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    reading = _events(spark, d).withColumn("page", fx.props_k())
    stored = stream.stored_result(sessions(reading, "6 hours"), "complete")
    return stored.select(
        "user_id", _time("session_window.start").alias("start"), "events", "first_page", "last_page"
    )


@query(
    """WITH marked AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '6 hours'
           THEN 0 ELSE 1 END AS opens FROM events),
       numbered AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM marked)
       SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS events FROM numbered GROUP BY user_id, session
       HAVING max(ts) + INTERVAL '6 hours' <= (SELECT max(ts) FROM events) - INTERVAL '1 hour'"""
)
def session_final_stream(spark: SparkSession, d: str) -> DataFrame:
    """Sessions that can no longer grow; they leave the state as they are written."""
    reading = _events(spark, d).withColumn("page", fx.props_k())
    stored = stream.stored_result(sessions(reading, "6 hours"), "append")
    return stored.select("user_id", _time("session_window.start").alias("start"), "events")


def _in_three_batches(spark: SparkSession, d: str, partial, fold, label: str) -> DataFrame:
    """Events in three batches, each of all users and times, with a restart before each; the stored result."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    root = fresh_path(spark, label)
    events = sample_table(spark, d, "events")
    for number in range(3):
        events.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == number).write.mode("append").parquet(f"{root}/in/events.parquet{number}")
        arriving = stream.event_stream(spark, f"{root}/in").withColumn("page", fx.props_k())
        sample = arriving.sparkSession.createDataFrame([], arriving.schema)
        table = StoredPartials(spark, f"{root}/table", partial(sample).schema, fold, compact_every=2)
        result = maintain(arriving, partial, table, f"{root}/checkpoint")
    return result


@query(
    """WITH marked AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '6 hours'
           THEN 0 ELSE 1 END AS opens FROM events),
       numbered AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM marked)
       SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS events,
              min(regexp_extract(props, '"k": (\\d+)', 1)::INTEGER) AS first_page,
              max(regexp_extract(props, '"k": (\\d+)', 1)::INTEGER) AS last_page
       FROM numbered GROUP BY user_id, session"""
)
def session_restart_stream(spark: SparkSession, d: str) -> DataFrame:
    """Sessions over restarts; events that come late close gaps between sessions that were stored before."""
    found = _in_three_batches(spark, d, lambda rows: session_partial(rows, "6 hours"), fold_sessions, "sessions")
    return found.select("user_id", _time("start").alias("start"), "events", "first_page", "last_page")


@query(
    """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, user_id, count(*) AS events,
              round(sum(value), 4) AS value FROM events GROUP BY ALL"""
)
def window_restart_stream(spark: SparkSession, d: str) -> DataFrame:
    """Windows over restarts, however late an event comes."""
    found = _in_three_batches(spark, d, lambda rows: window_partial(rows, "1 day"), fold_windows, "windows")
    return found.select(_time("window.start").alias("start"), "user_id", "events", F.round("value", 4).alias("value"))


_NOTES = f"""notes AS (SELECT conv_id::VARCHAR || ':' || turn::VARCHAR AS id, text AS user_memo, role AS book_title FROM conversations),
    docs AS (SELECT id, {_tokens('user_memo')} || {_tokens('book_title')} AS ts FROM notes),
    postings AS (SELECT id, unnest(ts) AS term FROM docs)"""


@query(
    f"""WITH {_NOTES}, {_bm25("'reaux', 'assistant', 'ment'")}
        SELECT id, round(sum(part), 6) AS score FROM parts GROUP BY id"""
)
def note_ingest_stream(spark: SparkSession, d: str) -> DataFrame:
    """Notes arrive as a stream with their index; the stored index is then searched."""
    schema = T.StructType(
        [
            T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
            T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
        ]
    )
    arriving = spark.readStream.schema(schema).parquet(f"{d}/conversations.parquet*").select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.col("text").alias("user_memo"), F.col("role").alias("book_title"),
    )
    root = fresh_path(spark, "notes")
    ingest_notes(arriving, root, ["user_memo", "book_title"])
    rows, sizes = (spark.read.parquet(f"{root}/{n}") for n in ("postings", "lengths"))
    scores = search.bm25(rows, sizes, ["reaux", "assistant", "ment"])
    return scores.withColumn("score", F.round("score", 6))


_CHANGED = f"""changed AS (SELECT id, ocr_text_plain, CASE WHEN id % 3 = 0 THEN 'revised ' || user_memo ELSE user_memo END AS user_memo,
        CASE WHEN id % 7 = 0 THEN 'appendix' ELSE book_title END AS book_title, voice_transcript FROM fx_notes WHERE id % 5 <> 0 OR id % 35 = 0),
    docs AS (SELECT id, {' || '.join(map(_tokens, NOTE_COLUMNS))} AS ts FROM changed),
    postings AS (SELECT id, unnest(ts) AS term FROM docs)"""


@query(
    f"""WITH {_CHANGED}, {_bm25("'revised', 'appendix', 'ment'")}
        SELECT s.id, s.score, n.book_title, length(n.user_memo) AS memo_chars FROM (
            SELECT id, round(sum(part), 6) AS score FROM parts GROUP BY id) s JOIN changed n ON n.id = s.id""",
    "fx_notes",
)
def note_change_stream(spark: SparkSession, d: str) -> DataFrame:
    """All notes are indexed; then a log of changes arrives in three batches, with a restart before each.

    Every third memo is rewritten, every fifth note is deleted, every seventh comes (back) with another title. The
    stored index is then searched, and its hits meet the stored notes.
    """
    notes = fx.notes(spark, d).select("id", *NOTE_COLUMNS)
    root = fresh_path(spark, "note-index")
    index = StoredIndex(spark, f"{root}/index", "id", tuple(NOTE_COLUMNS)).create(notes)
    revised = F.concat(F.lit("revised "), F.col("user_memo"))
    memo = F.when(F.col("id") % 3 == 0, revised).otherwise(F.col("user_memo")).alias("user_memo")
    other = [c for c in NOTE_COLUMNS if c != "user_memo"]
    batches = [
        # Written twice: the earlier change of an id loses against the later one of the batch.
        notes.where("id % 3 = 0").select("id", *NOTE_COLUMNS, F.lit(False).alias("deleted"), F.lit(1).alias("seq")).unionByName(
            notes.where("id % 3 = 0").select("id", *other, memo, F.lit(False).alias("deleted"), F.lit(2).alias("seq"))
        ),
        notes.where("id % 5 = 0").select("id", *NOTE_COLUMNS, F.lit(True).alias("deleted"), F.lit(3).alias("seq")),
        notes.where("id % 7 = 0").withColumn("book_title", F.lit("appendix")).withColumn("user_memo", memo).select(
            "id", *NOTE_COLUMNS, F.lit(False).alias("deleted"), F.lit(4).alias("seq")
        ),
    ]
    for batch in batches:
        batch.write.mode("append").parquet(f"{root}/changes")
        arriving = spark.readStream.schema(batch.schema).parquet(f"{root}/changes")
        maintain_index(arriving, index, ["seq"], f"{root}/checkpoint")
    terms = ["revised", "appendix", "ment"]
    scores = search.bm25(index.postings(terms), index.lengths(), terms)
    found = search.ranked_rows(scores.withColumn("score", F.round("score", 6)), index.documents(), "id")
    return found.select("id", "score", "book_title", F.char_length("user_memo").cast("long").alias("memo_chars"))
