"""The stored index: changes, repeated batches, compaction, pruning and the best documents."""

import random

import pytest
from pyspark.sql import functions as F

from leafmill.operators import search, text_index
from leafmill.operators.text_index import StoredIndex

COLUMNS = ("title", "body")
SCHEMA = "id long, title string, body string"
WORDS = [f"{a}{b}" for a in "abcdefghijk" for b in ("lpha", "eta", "amma")]


def documents(n, seed=0):
    draw = random.Random(seed)
    return [(i * 3, draw.choice(WORDS), " ".join(draw.choices(WORDS, k=draw.randrange(30)))) for i in range(n)]


def same_as(spark, index, rows, best=False):
    """The index against postings made from ``rows`` directly."""
    frame = spark.createDataFrame(rows, SCHEMA)
    wanted = search.postings(frame, "id", COLUMNS)
    assert sorted(map(tuple, index.postings().collect())) == sorted(map(tuple, wanted.collect()))
    assert sorted(map(tuple, index.lengths().collect())) == sorted(map(tuple, search.lengths(frame, "id", COLUMNS).collect()))
    assert sorted(map(tuple, index.documents().select("id", *COLUMNS).collect()), key=repr) == sorted(rows, key=repr)
    for terms in (["alpha", "beta"], ["nowhere"]) if best else ():
        scores = search.bm25(search.postings(frame, "id", COLUMNS, terms), search.lengths(frame, "id", COLUMNS), terms)
        best = [(r.id, round(r.score, 9)) for r in scores.orderBy(F.desc("score"), "id").limit(5).collect()]
        assert [(r.id, round(r.score, 9)) for r in index.best(terms, 5).collect()] == best


@pytest.fixture
def index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "BLOCK_IDS", 16)
    monkeypatch.setattr(text_index, "LEADING", 2)
    return StoredIndex(spark, f"file://{tmp_path}/index", "id", COLUMNS)


def changes(spark, rows):
    return spark.createDataFrame(rows, SCHEMA + ", deleted boolean")


def test_changes_repeats_and_compaction(spark, index):
    rows = documents(60)
    same_as(spark, index.create(spark.createDataFrame([*rows, (None, "alpha", "alpha")], SCHEMA)), rows, best=True)
    state = {r[0]: r for r in rows}
    first = [(3, "alpha", "new words", False), (6, None, None, True), (1000, "beta", None, None), (2000, "x", "y", True), (None, "alpha", "z", False)]
    for _ in range(2):  # a repeated batch replaces itself
        index.apply(changes(spark, first), 1)
    state |= {3: (3, "alpha", "new words"), 1000: (1000, "beta", None)}
    del state[6]
    index.apply(changes(spark, [(6, "back", "again", False), (3, None, None, True)]), 2)
    state[6] = (6, "back", "again")
    del state[3]
    same_as(spark, index, list(state.values()), best=True)
    with pytest.raises(ValueError):
        index.apply(changes(spark, first), 1)
    index.compact()
    index.apply(changes(spark, [(9, "gamma", "", False)]), 3)
    state[9] = (9, "gamma", "")
    index.apply(changes(spark, []), 4)
    same_as(spark, index, list(state.values()))


def test_a_batch_without_its_line_is_not_read(spark, index):
    rows = documents(20)
    index.create(spark.createDataFrame(rows, SCHEMA))
    spark.createDataFrame([(0,)], "id long").write.parquet(f"{index.root}/generation=0/touched/segment=1")
    same_as(spark, index, rows)


def test_terms_are_read_from_their_bucket(spark, index):
    index.create(spark.createDataFrame(documents(200), SCHEMA))
    plan = index.postings(["alpha"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "PushedFilters: [" in plan and "term" in plan.split("PushedFilters: [")[1].split("]")[0]
    assert {r.term for r in index.postings(prefixes=["al", "b"]).select("term").distinct().collect()} == {
        w for w in WORDS if w.startswith(("al", "b"))
    }


def test_frequent_terms_are_many_blocks(spark, index):
    index.create(spark.createDataFrame([(i, "the", "the") for i in range(100)], SCHEMA))
    blocks = index._read(["the"], None).collect()
    assert len(blocks) == 7 and max(b.docs for b in blocks) == 16 and {b.most for b in blocks} == {2}


def test_empty_index(spark, index):
    index.create(spark.createDataFrame([], SCHEMA))
    same_as(spark, index, [])
    index.apply(changes(spark, [(1, "alpha", None, False)]), 1)
    same_as(spark, index, [(1, "alpha", None)])


def test_texts_and_not_postings_are_dealt_out(spark, index):
    plan = text_index._blocks(spark.createDataFrame(documents(40), SCHEMA), "id", COLUMNS)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Generate" not in plan and "Aggregate" not in plan
    index.create(spark.createDataFrame(documents(200), SCHEMA))
    rows = index.postings().groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"), F.max("length").alias("length"))
    assert sorted(map(tuple, index.counts().collect())) == sorted(map(tuple, rows.collect()))


def test_a_long_range_goes_on_in_further_rows(spark, index, monkeypatch):
    monkeypatch.setattr(text_index, "BLOCK_TOKENS", 40)
    rows = documents(60)
    same_as(spark, index.create(spark.createDataFrame(rows, SCHEMA)), rows, best=True)
    assert index._read(None, None).groupBy("term", "block").count().where("count > 1").count() > 0
