import re

from pyspark.sql import functions as F

from leafmill.llm import exact_dedup
from tests.llm.helpers import LONG, docs, empty

TEXTS = ["a b", "a  b", "a\tb", "a b", None, "", " ", LONG, LONG + " ", "c", "a b"]


def brute(texts):
    first, size = {}, {}
    keys = [re.sub("[ \t-\r]+", " ", t or "") for t in texts]
    for i, k in enumerate(keys):
        first.setdefault(k, i)
        size[k] = size.get(k, 0) + 1
    return {i: (first[k], size[k], first[k] == i) for i, k in enumerate(keys)}


def found(df):
    return {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in df.collect()}


def test_odd_rows(spark):
    assert found(exact_dedup.duplicates(docs(spark, TEXTS))) == brute(TEXTS)
    assert found(exact_dedup.duplicates(docs(spark, TEXTS).repartition(5), salts=2)) == brute(TEXTS)
    assert exact_dedup.duplicates(empty(spark)).count() == 0


def test_colliding_digests_are_told_apart_by_content(spark):
    weak = lambda text: F.pmod(F.length(text), F.lit(2)).cast("string").cast("binary")
    assert found(exact_dedup.duplicates(docs(spark, TEXTS), digest=weak)) == brute(TEXTS)


def test_repeated_and_missing_ids(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "z")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in exact_dedup.duplicates(rows).collect())
    assert got == [(0, 0, 1, True), (0, 1, 3, False), (1, 1, 3, True), (1, 1, 3, True)]
