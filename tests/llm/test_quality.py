import random
import re
from math import comb

import pytest

from leafmill.llm import quality
from leafmill.llm.queries import op6_quality
from tests.llm.helpers import LONG, docs, empty

FOLDER = "/root/testdata/sf0.001"


def brute(text):
    text = text or ""
    words = re.findall("[^ \t-\r]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search("[^ \t-\r]", line):
            repeated += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), repeated, len(covered), failed


ODD = [
    None, "", " \n \n", "a b c d e f a b c d e", "x " * 40, "one\ntwo\none\n\none \n#*$%&|<>", "é\u00a0è \u2003 ü", "a\x0bb\x0cc\rd",
    " ".join(map(str, range(3000))) + " 0 1 2 3 4", "same", "same",
]


def test_counts_of_odd_rows(spark):
    rows = quality.judge(quality.measure(docs(spark, ODD)), quality.cutoffs(quality.measure(docs(spark, ODD)), spark.createDataFrame([], "doc_id long, quality int")))
    found = {r.doc_id: r for r in rows.collect()}
    for i, text in enumerate(ODD):
        r = found[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(text), text
        assert r.kept == (not r.base_failed)
    assert quality.rate(empty(spark), spark.createDataFrame([], "doc_id long, quality int")).count() == 0
    assert quality.measure(docs(spark, [LONG])).first().n_words == 60_001


def test_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    for r in op6_quality(spark, FOLDER).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(texts[r.doc_id])


@pytest.mark.parametrize("n, k, p", [(10, 0, 0.1), (300, 2, 0.02), (5000, 40, 0.01), (5000, 0, 0.01)])
def test_tail_is_exact(n, k, p):
    wanted = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    assert quality._tail(n, k, p) == pytest.approx(wanted, rel=1e-9)


def labelled(spark, good_symbols):
    """5,000 good and 500 bad documents of twenty words; bad ones have a symbol each second word."""
    draw = random.Random(2)
    clean = lambda: " ".join(f"w{draw.randrange(9999)}" for _ in range(20))
    texts = [clean().replace(" ", "# ") if i < good_symbols else clean() for i in range(5000)]
    texts += [clean().replace(" ", "# ") for _ in range(500)]
    labels = spark.createDataFrame([(i, int(i < 5000)) for i in range(5500)] + [(0, None), (77_777, 1)], "doc_id long, quality int")
    return docs(spark, texts), labels


def test_cutoffs_reject_bad_and_keep_good(spark):
    rows, labels = labelled(spark, 0)
    found = quality.rate(rows, labels).collect()
    assert all(r.kept for r in found if r.doc_id < 5000)
    assert not any(r.kept for r in found if r.doc_id >= 5000)


def test_no_cutoff_without_proof(spark):
    """Where one good document in twenty looks bad, the rule rests; so it does on few labels."""
    rows, labels = labelled(spark, 250)
    assert all(r.kept for r in quality.rate(rows, labels).collect())
    rows, labels = labelled(spark, 0)
    few = labels.where("doc_id < 100 or doc_id >= 5450")
    assert all(r.kept for r in quality.rate(rows, few).collect())
