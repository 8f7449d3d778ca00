"""Queries over conversion plans, progress and caller-supplied functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.operators import convert, layout, merge, signal, slots
from leafmill.plans import fixtures as fx
from leafmill.plans.registry import query
from leafmill.plans.signal_queries import _BANK, _FRAMES, _SPECTRUM
from leafmill.session import keep
from leafmill.sources.tables import sample_table

_PLAN = """plan AS (SELECT id AS book_id, total_pages, unnest(range(1, total_pages + 1))::INTEGER AS page_number FROM fx_books),
    done AS (SELECT p.book_id, p.page_number FROM fx_pages p JOIN labels l ON l.doc_id = p.id),
    left_over AS (SELECT * FROM plan WHERE (book_id, page_number) NOT IN (SELECT book_id, page_number FROM done))"""


def _finished(spark: SparkSession, d: str) -> DataFrame:
    labelled = sample_table(spark, d, "labels").select(F.col("doc_id").alias("id"))
    return fx.page_numbers(spark, d).join(labelled, "id", "left_semi")


@query(
    f"""WITH {_PLAN} SELECT book_id, ((page_number - 1) // 10)::INTEGER AS batch, count(*) AS pages,
        min(page_number) AS first_page, max(page_number) AS last_page FROM plan GROUP BY ALL""",
    "fx_books fx_pages",
)
def batch_plan(spark: SparkSession, d: str) -> DataFrame:
    return convert.batch_sizes(convert.work_plan(fx.books(spark, d)))


@query(
    f"WITH {_PLAN} SELECT book_id, page_number, ((page_number - 1) // 10)::INTEGER AS batch FROM left_over",
    "fx_books fx_pages",
)
def remaining_pages(spark: SparkSession, d: str) -> DataFrame:
    plan = convert.work_plan(fx.books(spark, d), _finished(spark, d))
    return convert.spread_plan(plan).select("book_id", "page_number", "batch")


@query(
    f"""WITH {_PLAN} SELECT book_id, page_number FROM plan
        WHERE (page_number - 1) % 10 = 0 OR page_number = total_pages""",
    "fx_books fx_pages",
)
def sampled_progress(spark: SparkSession, d: str) -> DataFrame:
    plan = convert.page_sequence(fx.books(spark, d))
    return convert.sampled_progress(plan).select("book_id", "page_number")


_ALLOWED = " OR ".join(
    f"(before = '{s}' AND status IN ({', '.join(repr(n) for n in nexts)}))"
    for s, nexts in convert.NEXT_STATUS.items()
)
_STEPS = f"""steps AS (SELECT book_id, seq, status, before, coalesce({_ALLOWED}, false) AS allowed FROM (
    SELECT *, coalesce(lag(status) OVER (PARTITION BY book_id ORDER BY updated_at, seq), 'pending') AS before
    FROM fx_progress))"""


@query(f"WITH {_STEPS} SELECT book_id, seq, before, status, allowed FROM steps", "fx_progress")
def progress_transitions(spark: SparkSession, d: str) -> DataFrame:
    steps = convert.progress_transitions(fx.progress_log(spark, d))
    return steps.select("book_id", "seq", "before", "status", "allowed")


@query(
    f"""WITH {_STEPS}, sums AS (SELECT book_id, count(*) AS events, count_if(NOT allowed)::BIGINT AS rejected FROM steps GROUP BY book_id)
        SELECT book_id, events, rejected, last_processed_page, status FROM sums JOIN (
          SELECT book_id, last_processed_page, status,
                 row_number() OVER (PARTITION BY book_id ORDER BY updated_at DESC, seq DESC) AS n FROM fx_progress)
        USING (book_id) WHERE n = 1""",
    "fx_progress",
)
def progress_state(spark: SparkSession, d: str) -> DataFrame:
    log = fx.progress_log(spark, d)
    sums = convert.progress_transitions(log).groupBy("book_id").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(~F.col("allowed")).alias("rejected")
    )
    latest = merge.fold_latest(log, "book_id", ["updated_at", "seq"])
    return sums.join(latest, "book_id").select(
        "book_id", "events", "rejected", "last_processed_page", "status"
    )


@query(
    """WITH batches AS (SELECT user_id AS book_id, regexp_extract(props, '"k": (\\d+)', 1)::INTEGER % 10 + 1 AS pages,
           trunc(value * 10)::BIGINT AS elapsed_ms FROM events WHERE event_type = 'view')
       SELECT book_id, sum(pages)::BIGINT AS pages, count(*) AS batches, sum(elapsed_ms)::BIGINT AS elapsed_ms,
              round(avg(elapsed_ms), 6) AS ms_per_batch, round(sum(pages) * 1000.0::DOUBLE / sum(elapsed_ms), 6) AS pages_per_second
       FROM batches GROUP BY book_id"""
)
def throughput(spark: SparkSession, d: str) -> DataFrame:
    batches = sample_table(spark, d, "events").filter("event_type = 'view'").select(
        F.col("user_id").alias("book_id"), (fx.props_k() % 10 + 1).alias("pages"),
        (F.col("value") * 10).cast("long").alias("elapsed_ms"),
    )
    rates = convert.throughput(batches)
    return rates.withColumns(
        {c: F.round(c, 6) for c in ("ms_per_batch", "pages_per_second")}
    )


def _letter_counter():
    """A function that fails on some texts always and on some at the first try alone."""
    tried = set()

    def count(rows):
        sizes = [len(row["text"]) for row in rows]
        if any(size % 7 == 0 for size in sizes):
            raise ValueError("unreadable page")
        if any(size % 5 == 0 for size in sizes):
            if len(rows) > 1 or rows[0]["doc_id"] not in tried:
                tried.update(row["doc_id"] for row in rows if len(rows) == 1)
                raise OSError("busy")
        return [len(row["text"].encode("ascii", "ignore")) for row in rows]

    return count


@query(
    """SELECT doc_id, CASE WHEN length(text) % 7 = 0 THEN -1 ELSE length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) END AS result,
              CASE WHEN length(text) % 7 = 0 THEN 'skipped' ELSE 'ok' END AS status,
              CASE WHEN length(text) % 7 = 0 OR length(text) % 5 = 0 THEN 2 ELSE 1 END AS attempts,
              CASE WHEN length(text) % 7 = 0 THEN 'ValueError: unreadable page' END AS error FROM documents"""
)
def conversion_slot(spark: SparkSession, d: str) -> DataFrame:
    documents = fx.documents(spark, d).select("doc_id", "text")
    outcomes = slots.run_slot(documents, ["doc_id"], _letter_counter, T.LongType())
    return outcomes.withColumn("result", F.coalesce("result", F.lit(-1)))


def _line_engine():
    """Stands in for page recognition: every non-empty line is a region."""

    def find(rows):
        return [page(row["text"].split("\n")) for row in rows]

    def page(lines):
        if len(lines) > 60:
            raise ValueError("page too dense")
        return [
            {
                "ix": i, "x1": 0.0, "y1": 24.0 * i, "x2": 8.0 * len(line), "y2": 24.0 * i + 20.0,
                "confidence": 1.0 / (1 + i), "is_vertical": False, "direction": 0, "text": line,
            }
            for i, line in enumerate(lines)
            if line
        ]

    return find


@query(
    """WITH lines AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
       regions AS (SELECT doc_id, unnest(ls) AS text, unnest(range(len(ls)))::INTEGER AS ix FROM lines WHERE len(ls) <= 60)
       SELECT doc_id, count(*) AS regions, round(max(8.0::DOUBLE * length(text)), 6) AS width,
              round(avg(1.0::DOUBLE / (1 + ix)), 6) AS confidence FROM regions WHERE text <> '' GROUP BY doc_id"""
)
def recognition_slot(spark: SparkSession, d: str) -> DataFrame:
    documents = fx.documents(spark, d).select("doc_id", "text")
    # What an engine found is kept, so that it runs once per page.
    found = keep(slots.recognise_pages(documents, ["doc_id"], _line_engine))
    regions = found.filter("status = 'ok' and text is not null")
    scored = layout.page_confidence(regions, ["doc_id"])
    sizes = regions.groupBy("doc_id").agg(F.count(F.lit(1)).alias("regions"), F.max("x2").alias("width"))
    return sizes.join(scored, "doc_id").select(
        "doc_id", "regions", F.round("width", 6).alias("width"), F.round("confidence", 6).alias("confidence")
    )


def _loudest_engine():
    """Stands in for transcription: a letter per frame for its strongest filter."""

    def letter(frame):
        return "abcd"[max(range(4), key=lambda m: frame[m])]

    def listen(rows):
        return ["".join(map(letter, row["features"])) for row in rows]

    return listen


@query(
    f"""WITH {_FRAMES}, {_SPECTRUM}, {_BANK}, loudest AS (SELECT signal_id, frame, (frame // 4)::BIGINT AS block,
            substring('abcd', arg_max(mel, value)::INTEGER + 1, 1) AS letter FROM logmel GROUP BY signal_id, frame)
        SELECT signal_id, block, string_agg(letter, '' ORDER BY frame) AS text, 'ok' AS status, 1 AS attempts
        FROM loudest GROUP BY signal_id, block""",
    "fx_signal",
)
def transcription_slot(spark: SparkSession, d: str) -> DataFrame:
    features = signal.log_mel(fx.samples(spark, d), **fx.SIGNAL)
    return slots.transcribe(features, _loudest_engine, 4).select(
        "signal_id", "block", F.col("result").alias("text"), "status", "attempts"
    )


def _short_definer():
    """Stands in for a definition engine; it knows no words for copper."""

    def define(rows):
        if any("copper" in row["word"] or row["key"] % 11 == 0 for row in rows):
            raise LookupError("no entry")
        return [f"{row['word']}: used in {row['context']}" for row in rows]

    return define


@query(
    """SELECT p_partkey, CASE WHEN ok THEN p_name || ': used in ' || p_type END AS definition,
              CASE WHEN ok THEN 'ok' ELSE 'skipped' END AS status, CASE WHEN ok THEN 1 ELSE 2 END AS attempts,
              CASE WHEN NOT ok THEN 'LookupError: no entry' END AS error
       FROM (SELECT *, NOT contains(p_name, 'copper') AND p_partkey % 11 <> 0 AS ok FROM part)"""
)
def definition_slot(spark: SparkSession, d: str) -> DataFrame:
    words = sample_table(spark, d, "part").select(
        F.col("p_partkey"), F.col("p_partkey").alias("key"), F.col("p_name").alias("word"), F.col("p_type").alias("context")
    )
    return slots.define(words, ["p_partkey"], _short_definer)
