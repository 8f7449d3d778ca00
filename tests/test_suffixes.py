"""Suffix order and repeated substrings over the cluster, against plain sorting, with groups and slices cut small."""

import random

import pytest
from pyspark.sql import functions as F

from leafmill.operators import repeats, suffixes
from tests.test_golden import brute_nodes

TEXTS = ["abracadabra", "a" * 90, "ab" * 40 + "c", "banana$band$$", "x", "é😀é" * 20, "ab" * 40 + "c", "mississippi" * 9, "b"]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "k int, t string")


def placed(spark, texts, **limits):
    rows, _ = suffixes.numbered(frame(spark, texts), "t", [])
    ranked = suffixes.rank(rows, **limits)
    return ranked, suffixes.neighbours(ranked, limits.get("slice_rows", suffixes.SLICE_ROWS))


def common(a: str, b: str) -> int:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


@pytest.mark.parametrize("limits", [{}, {"group_rows": 1, "slice_rows": 7}])
def test_order_over_all_texts(spark, limits):
    """Equal suffixes of several texts stand in the order of the texts."""
    _, rows = placed(spark, TEXTS, **limits)
    got = [(r._t, r.pos, r.shared) for r in rows.orderBy("rank").collect()]
    ids = {t: n for n, t in enumerate(sorted({t for t, _, _ in got}))}
    order = sorted((t[i:], k, i) for k, t in enumerate(TEXTS) for i in range(len(t)))
    wanted = [(k, i, common(s, order[n - 1][0]) if n else 0) for n, (s, k, i) in enumerate(order)]
    assert [(ids[t], p, s) for t, p, s in got] == wanted
    assert [r["rank"] for r in rows.orderBy("rank").collect()] == list(range(len(wanted)))


@pytest.mark.parametrize("slice_rows, slices", [(1, 2), (5, 3), (65_536, 64)])
def test_nodes_are_stitched_over_slices(spark, slice_rows, slices):
    _, rows = placed(spark, TEXTS)
    texts, _ = suffixes.numbered(frame(spark, TEXTS), "t", [])
    found = suffixes.nodes(rows, slice_rows, slices)
    got = {r.gram: r.freq for r in suffixes.substrings(found, texts).collect()}
    wanted = brute_nodes(*TEXTS)
    wanted.pop("")
    assert got == wanted


def test_rounds_follow_the_logarithm(spark, monkeypatch):
    """Two equal texts: every suffix of one is a node; long blocks are put together from short ones."""
    draw = random.Random(1)
    text = "".join(draw.choice("abcd") for _ in range(5_000))
    rounds = []
    renumbered = suffixes._renumbered
    monkeypatch.setattr(suffixes, "_renumbered", lambda *a: rounds.append(1) or renumbered(*a))
    found = repeats.repeat_places(frame(spark, [text, text]).withColumn("g", F.lit(1)), ["g"], "t")
    whole = found.where("length > 100").agg(F.max("length"), F.count(F.lit(1)), F.max("freq")).first()
    assert tuple(whole) == (5_000, 4_900, 2) and len(rounds) <= 6


def test_a_long_text_is_in_many_partitions(spark):
    draw = random.Random(2)
    text = "".join(draw.choice("abcdefgh") for _ in range(100_000))
    rows, _ = suffixes.numbered(frame(spark, [text]), "t", None)
    coalesce = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked = suffixes.rank(rows, group_rows=10_000)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    tasks = ranked.rows.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 1 and max(r["count"] for r in tasks) < 100_000
    order = sorted(range(len(text)), key=lambda i: text[i:])
    sample = {i: order[i] for i in range(0, len(text), 997)}
    got = {r["rank"]: r.pos for r in ranked.rows.where(F.col("rank") % 997 == 0).collect()}
    assert got == sample


def test_repeated_keys_and_odd_texts(spark):
    rows = spark.createDataFrame([(1, "abab"), (1, "ba"), (None, "aa"), (None, None), (2, "")], "k int, t string")
    got = sorted((r.k or 0, r.gram, r.freq) for r in repeats.repeated_substrings(rows, ["k"], "t").collect())
    one, none = brute_nodes("abab", "ba"), brute_nodes("aa")
    assert got == sorted([(1, g, n) for g, n in one.items()] + [(0, g, n) for g, n in none.items()])
    order = repeats.suffix_order(rows, "k", "t").collect()
    assert sorted((r.k or 0, r["rank"], r.pos) for r in order) == [(0, 0, 1), (0, 1, 0), (1, 0, 1), (1, 0, 2), (1, 1, 0), (1, 1, 0), (1, 2, 3), (1, 3, 1)]
    assert repeats.suffix_order(rows.limit(0), "k", "t").collect() == []
    assert repeats.repeated_substrings(rows.limit(0), ["k"], "t").collect() == []
