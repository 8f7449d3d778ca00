"""A stored table under upserts, patches and deletes, repeated and failed changes."""

import pytest
from pyspark.sql import functions as F

from leafmill.operators.stored_table import StoredTable

SCHEMA = "id long, word string, n int"


@pytest.fixture
def table(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"w{i}", i) for i in range(100)], SCHEMA)
    return StoredTable(spark, f"file://{tmp_path}/table", rows.schema, "id", buckets=8).create(rows)


def content(table):
    return {r.id: (r.word, r.n) for r in table.read().collect()}


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_changes(spark, table):
    state = {i: (f"w{i}", i) for i in range(100)}
    assert content(table) == state
    new = [(3, "three", None), (1000, None, 1), (None, "nameless", 0)]
    for _ in range(2):  # a repeated change replaces itself
        assert len(table.upsert(rows(spark, new), 1)) <= 3
    state |= {i: (w, n) for i, w, n in new}
    assert content(table) == state
    table.patch(rows(spark, [(3, None, 33), (4, "four", None), (5000, "unknown", 1)]), ["word", "n"], 2)
    state |= {3: ("three", 33), 4: ("four", 4)}
    assert content(table) == state
    for _ in range(2):
        table.delete(rows(spark, [(5, None, None), (None, None, None), (6000, None, None), (5, "again", 1)]), 3)
    del state[5], state[None]
    assert content(table) == state
    with pytest.raises(ValueError):
        table.delete(rows(spark, [(7, None, None)]), 2)
    assert table.upsert(rows(spark, []), 4) == []
    table.delete(table.read(), 5)
    assert content(table) == {}
    table.upsert(rows(spark, [(1, "one", 1)]), 6)
    assert content(table) == {1: ("one", 1)}


def test_only_touched_buckets_are_written_and_read(spark, table):
    touched = table.upsert(rows(spark, [(3, "three", 3)]), 1)
    assert len(touched) == 1
    written = spark.read.parquet(f"{table.root}/data").where("change = 1").select("bucket").distinct().collect()
    assert [r.bucket for r in written] == touched
    found = table.read([3, 50])
    assert {r.id: r.word for r in found.collect()} == {3: "three", 50: "w50"}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_a_change_that_failed_half_way_is_not_read(spark, table):
    before = content(table)
    bad = rows(spark, [(8, "eight", 8)]).withColumn("n", F.when(F.col("id") == 8, F.raise_error(F.lit("stop")).cast("int")))
    with pytest.raises(Exception, match="stop"):
        table.upsert(bad, 1)
    assert content(table) == before
    table.upsert(rows(spark, [(8, "eight", 8)]), 1)
    assert content(table) == before | {8: ("eight", 8)}
