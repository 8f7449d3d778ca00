import re

import __spark_entry__ as entry
import corpus_pipeline
from leafmill.llm import quality
from tests.llm.helpers import docs, empty
from tests.llm.test_ngram_join import brute as near
from tests.llm.test_packing import check, ids_of, tokenizer  # noqa: F401
from tests.llm.test_quality import brute as counted

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark, tokenizer):  # noqa: F811
    """Each stage against brute force on what the one before left."""
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, left = rows.columns, {r.doc_id: r.text for r in rows.collect()}
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, rows, FOLDER)
        if name == "packed":
            check(found.collect(), {i: ids_of(tokenizer, t) for i, t in left.items()})
            break
        assert found.columns == columns
        got = {r.doc_id: r.text for r in found.collect()}
        if name == "quality_rules":  # too few labels here for a cutoff
            assert set(got) == {i for i, t in left.items() if not counted(t)[-1]}
        elif name == "exact_duplicates":
            first = {}
            for i in sorted(left):
                first.setdefault(re.sub("[ \t-\r]+", " ", left[i]), i)
            assert set(got) == set(first.values())
        elif name == "near_duplicates":
            assert set(got) == {i for i, (_, root) in near(left, 5, 80).items() if i == root}
        else:
            assert set(got) == set(left)
            assert all(t == left[i] or re.search(r"\[(EMAIL|IP|CARD|PHONE)\]", t) for i, t in got.items())
        rows, left = spark.createDataFrame(found.collect(), found.schema), got


def test_odd_rows_pass_every_stage(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    prose = " ".join(f"w{i}" for i in range(40))
    odd = docs(spark, [None, "", prose, prose, prose + " a@b.co", "x " * 50])
    for rows in (odd, empty(spark)):
        rows.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        found = corpus_pipeline.run(spark, str(tmp_path)).collect()
        assert {r.doc_id for r in found} == ({2} if rows is odd else set())


def test_rows_that_share_an_id_are_judged_each(spark, tmp_path):
    """A rejected row goes though another of its id stays; equal rows, with and without an id, stay once."""
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    edited = c.replace("c59", "changed")
    rows = [(1, a), (1, "too short"), (1, a), (None, a), (2, b), (2, b), (None, b), (None, d), (None, d), (5, c), (None, edited), (7, c + " end"), (None, None)]
    docs_ = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    left = stages["quality_rules"](spark, docs_, str(tmp_path))
    assert sorted(map(repr, ((r.doc_id, r.text) for r in left.collect()))) == sorted(repr(r) for r in rows if r[1] and r[1] != "too short")
    left = stages["exact_duplicates"](spark, left, str(tmp_path))
    once = [(1, a), (2, b), (None, d), (5, c), (None, edited), (7, c + " end")]
    assert sorted(map(repr, ((r.doc_id, r.text) for r in left.collect()))) == sorted(map(repr, once))
    left = stages["near_duplicates"](spark, left, str(tmp_path))
    assert sorted(map(repr, ((r.doc_id, r.text) for r in left.collect()))) == sorted(map(repr, [(1, a), (2, b), (None, d), (5, c)]))


def test_entry_lists_it():
    assert "pipeline" in entry.queries() and "pipeline" not in entry.oracle_sql()
    assert quality.RISK < 0.05
