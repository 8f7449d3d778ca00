"""Streams over files that arrive in several batches."""

import datetime

import pytest
from pyspark.sql import functions as F

from leafmill.operators import search
from leafmill.streaming import events as stream
from leafmill.streaming.notes import ingest_notes
from leafmill.streaming.partials import StoredPartials, fold_sessions, session_partial
from leafmill.streaming.progress import maintain_progress
from leafmill.streaming.windows import sessions, window_counts

DAY = datetime.datetime(2024, 1, 1)


def write(spark, folder, number, rows):
    """One file of events: (id, minutes, user, type, value, page)."""
    data = [
        (i, DAY + datetime.timedelta(minutes=m), u, t, v, f'{{"k": {k}}}')
        for i, m, u, t, v, k in rows
    ]
    spark.createDataFrame(data, stream.EVENT_SCHEMA).coalesce(1).write.parquet(
        f"{folder}/events.parquet{number}"
    )


def pages(spark, folder):
    return stream.event_stream(spark, folder, files_per_batch=1).select(
        F.col("user_id").alias("book_id"), F.get_json_object("props", "$.k").cast("int").alias("page"),
        F.col("event_type").alias("status"), "ts", "event_id",
    )


def test_progress_goes_on_after_a_restart(spark, tmp_path):
    folder, path, place = (str(tmp_path / n) for n in ("in", "table", "checkpoint"))
    write(spark, folder, 0, [(1, 0, 7, "processing", 1.0, 5), (2, 5, 8, "pending", 1.0, 0)])
    maintain_progress(pages(spark, folder), path, place)
    # The second file has an event older than one already seen.
    write(spark, folder, 1, [(3, 9, 7, "completed", 1.0, 9), (0, -5, 8, "failed", 1.0, 3)])
    table = maintain_progress(pages(spark, folder), path, place)
    found = {r.book_id: (r.last_processed_page, r.status) for r in table.collect()}
    assert found == {7: (9, "completed"), 8: (3, "pending")}


def test_windows_drop_repeats_and_late_events(spark, tmp_path):
    folder = str(tmp_path / "in")
    write(spark, folder, 0, [(1, 0, 1, "view", 1.0, 1), (1, 0, 1, "view", 1.0, 1), (2, 3, 1, "view", 2.0, 1)])
    write(spark, folder, 1, [(3, 300, 1, "view", 4.0, 1)])
    # Rows count as late by the watermark of the batch before.
    write(spark, folder, 2, [(6, 310, 1, "view", 1.0, 1)])
    write(spark, folder, 3, [(4, 1, 1, "view", 8.0, 1), (5, 600, 1, "view", 1.0, 1)])
    events = stream.event_stream(spark, folder, files_per_batch=1)
    done = stream.stored_result(window_counts(events, "10 minutes", delay="1 hour"), "append")
    found = {r.start: (r.events, r.value) for r in done.select("window.start", "events", "value").collect()}
    assert found[DAY] == (2, 3.0)


def test_sessions(spark, tmp_path):
    folder = str(tmp_path / "in")
    write(spark, folder, 0, [(i, m, 1, "view", 0.0, i) for i, m in enumerate((0, 20, 45, 80, 200))])
    events = stream.event_stream(spark, folder).withColumn(
        "page", F.get_json_object("props", "$.k").cast("int")
    )
    done = stream.stored_result(sessions(events, "30 minutes"), "complete").orderBy("session_window").collect()
    assert [(r.events, r.first_page, r.last_page) for r in done] == [(3, 0, 2), (1, 3, 3), (1, 4, 4)]


def test_notes_and_index_grow_together(spark, tmp_path):
    folder, root, place = (str(tmp_path / n) for n in ("in", "store", "checkpoint"))
    schema = "id long, memo string"
    for number, rows in enumerate([[(1, "alpha beta")], [(2, "beta"), (3, "gamma")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        arriving = spark.readStream.schema(schema).parquet(folder)
        ingest_notes(arriving, root, ["memo"], place)
        assert spark.read.parquet(f"{root}/notes").count() == (1, 3)[number]
    rows, sizes = (spark.read.parquet(f"{root}/{n}") for n in ("postings", "lengths"))
    scores = {r.id: r.score for r in search.bm25(rows, sizes, ["beta", "gamma"]).collect()}
    assert set(scores) == {1, 2, 3} and scores[3] == max(scores.values())


def test_progress_writes_changed_books_only(spark, tmp_path):
    folder, path, place = (str(tmp_path / n) for n in ("in", "table", "checkpoint"))
    for number in range(5):
        write(spark, folder, number, [(10 * number + i, number, 100 * (number > 0) + i, "done", 1.0, i) for i in range(30 if number == 0 else 1)])
        table = maintain_progress(pages(spark, folder), path, place, compact_every=3)
    assert table.count() == 31
    rows = spark.read.parquet(f"{path}/batches").groupBy("batch").count().collect()
    assert {r.batch: r["count"] for r in rows} == {0: 30, 1: 1, 2: 1, 3: 1, 4: 1}
    assert [r.upto for r in spark.read.parquet(f"{path}/folded").select("upto").distinct().collect()] == [2]


def test_late_events_merge_stored_sessions(spark, tmp_path):
    """Two stored sessions become one when an event between them comes late; a repeated batch changes nothing."""
    schema = "ts timestamp, user_id long, page int"
    at = lambda *minutes: spark.createDataFrame([(DAY + datetime.timedelta(minutes=m), 1, m) for m in minutes], schema)
    partial = lambda rows: session_partial(rows, "30 minutes")
    for every in (50, 1):
        table = StoredPartials(spark, str(tmp_path / f"t{every}"), partial(at()).schema, fold_sessions, every)
        assert table.read().count() == 0
        table.add(partial(at(0, 50, 200)), 0)
        assert table.read().count() == 3
        for _ in range(2):
            table.add(partial(at(25, 230)), 1)
        found = table.read().orderBy("start").collect()
        assert [(r.events, r.first_page, r.last_page) for r in found] == [(3, 0, 50), (1, 200, 200), (1, 230, 230)]


def test_a_stored_result_goes_on_after_a_restart(spark, tmp_path):
    folder, path, place = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    for number in range(2):
        write(spark, folder, number, [(number, number, 1, "view", 1.0, 1)])
        for _ in range(2):  # the second run finds nothing new
            counts = window_counts(stream.event_stream(spark, folder), "1 hour")
            done = stream.stored_result(counts, "complete", path, place).collect()
            assert [r.events for r in done] == [number + 1]


def test_an_empty_stream(spark, tmp_path):
    write(spark, str(tmp_path), 0, [])
    events = stream.event_stream(spark, str(tmp_path))
    assert stream.stored_result(window_counts(events, "1 hour"), "complete").count() == 0


@pytest.fixture(autouse=True)
def utc(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
