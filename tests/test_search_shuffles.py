"""What moves between tasks in searches over whole tables: texts and counts by document, never postings or products."""

import random
from collections import Counter

from pyspark.sql import functions as F

from leafmill.operators import repeats, search


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def notes(spark):
    rows = [(i, " ".join(f"w{(i * k) % 7}" for k in range(1, 9))) for i in range(40)]
    return spark.createDataFrame([*rows, (3, "w1 w1 again"), (None, "w2"), (50, None)], "id int, memo string")


def test_many_queries_are_scored_where_a_document_is(spark, monkeypatch):
    monkeypatch.setattr(search, "TASK_PARTS", 10)
    rows, sizes = search.postings(notes(spark), "id", ["memo"]), search.lengths(notes(spark), "id", ["memo"])
    asked = spark.createDataFrame([(q, f"w{t}") for q in range(5) for t in range(q + 1)] + [(1, "w1"), (9, "none")], "query_id int, term string")
    scores = search.bm25_many(rows, sizes, asked)
    assert "hashpartitioning(id" in plan_of(scores) and "hashpartitioning(query_id" not in plan_of(scores)
    counts = rows.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"), F.max("length").alias("length"))
    found = sorted((r.query_id, r.id or -1, round(r.score, 9)) for r in scores.collect())
    assert found == sorted((r.query_id, r.id or -1, round(r.score, 9)) for r in search.bm25_many(counts, sizes, asked).collect())
    for query in range(5):
        alone = search.bm25(rows, sizes, [f"w{t}" for t in range(query + 1)]).collect()
        assert sorted((r.id or -1, round(r.score, 9)) for r in alone) == [(i, s) for q, i, s in found if q == query]


def test_an_index_is_gathered_without_a_shuffle_of_postings(spark, monkeypatch):
    monkeypatch.setattr(search, "TASK_BYTES", 50)
    plain = search.inverted_index(search.postings(notes(spark), "id", ["memo"]))
    dealt = search.inverted_index(search.postings(search.by_document(notes(spark), "id", ["memo"]), "id", ["memo"]))
    assert "hashpartitioning(term" in plan_of(plain) and "hashpartitioning(term" not in plan_of(dealt)
    assert sorted(map(str, dealt.collect())) == sorted(map(str, plain.collect()))


def test_passages_meet_by_numbers(spark):
    texts = spark.createDataFrame([("a b c d",), ("x a b c a b c",), ("d e f d e f",), (None,), ("a",)], "t string")
    places = repeats._repeated_places(repeats._told_apart(texts), "t", 3)
    assert "hashpartitioning(hash" in plan_of(places) and places.columns == ["_t", "pos"]
    found = {tuple(r) for r in repeats.repeated_passages(texts, "t", 3).collect()}
    assert found == {("a b c", 3, 2)}


def test_runs_meet_by_numbers(spark):
    """As passages: hashes are dealt out once, and no table of those that come again is broadcast."""
    texts = spark.createDataFrame([(1, "a b c d"), (1, "x a b c a b c"), (2, "d e f d e f"), (3, None), (None, "y a b c d")], "k int, t string")
    runs = repeats.repeated_runs(texts, "k", "t", 3)
    assert "hashpartitioning(hash" in plan_of(runs) and runs.columns == ["k", "start", "words"]
    assert sorted((r.k or 0, r.start, r.words) for r in runs.collect()) == [(0, 1, 4), (1, 0, 4), (1, 1, 3), (1, 4, 3)]


def passages_of(texts, length):
    """What ``repeated_passages`` must give for texts of words and single spaces."""
    total, documents = Counter(), Counter()
    for text in texts:
        words = text.split()
        own = Counter(" ".join(words[i : i + length]) for i in range(len(words) - length + 1))
        total.update(own)
        documents.update(own.keys())
    return {(p, total[p], n) for p, n in documents.items() if n > 1}


def test_passages_move_once_as_stretches(spark):
    """One shuffle, of texts by part: no hash per passage, no text kept or joined, no passage moved by itself."""
    texts = spark.createDataFrame([("a b c d",), ("x a b c a b c",), (None,), ("",), (" ,",), ("a",)], "t string")
    found = repeats.repeated_passages(texts, "t", 3)
    plan = plan_of(found)
    assert plan.count("Exchange") == 1 and "hashpartitioning(part" in plan and "Join" not in plan
    assert {tuple(r) for r in found.collect()} == {("a b c", 3, 2)}
    assert {tuple(r) for r in repeats.repeated_passages(texts, "t", 1).collect()} == {("a", 4, 3), ("b", 3, 2), ("c", 3, 2)}


def test_passages_over_packs_and_pieces(spark):
    dealt = random.Random(4)
    some = ["a", "of", "\u00e9t\u00e9", "\u732b", "12", "longerwordthanothers"]
    texts = [" ".join(dealt.choices(some, k=dealt.randrange(30))) for _ in range(60)]
    texts += [*texts[:20], "of " * 1000, "of " * 700 + "a", "short"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").repartition(3)
    for length in (2, 8):
        packed = repeats._packed(rows, "t", length, 5, pack_bytes=400, piece_bytes=90)
        found = [tuple(r) for r in repeats._counted(packed, length).collect()]
        assert len(found) == len(set(found)) and set(found) == passages_of(texts, length)


def test_passages_of_equal_hashes_are_told_apart(spark):
    """Words that differ in the middle only have one hash; passages are counted by their words."""
    one, other = (f"beginning{i}x{i}theirending" for i in "pq")
    texts = [f"{one} x {other} x {one} x", f"y {other} x", f"{one} z"]
    first, second = repeats._Lines(f"{one} {other}".encode()).hashes()
    assert first == second
    found = {tuple(r) for r in repeats.repeated_passages(spark.createDataFrame([(t,) for t in texts], "t string"), "t", 2).collect()}
    assert found == passages_of(texts, 2) == {(f"{other} x", 2, 2)}
