import hashlib
import random
from collections import Counter

import pytest

from leafmill.llm import substring_dedup
from leafmill.llm.queries import op8_substring_dedup
from tests.llm.helpers import LONG, docs, empty

FOLDER = "/root/testdata/sf0.001"


def brute(texts, window):
    words = {i: (t or "").encode().split() for i, t in texts.items()}
    count = Counter(tuple(w[i : i + window]) for w in words.values() for i in range(len(w) - window + 1))
    out = {}
    for i, w in words.items():
        gone = {a + k for a in range(len(w) - window + 1) if count[tuple(w[a : a + window])] > 1 for k in range(window)}
        out[i] = len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()
    return out


def sample():
    draw = random.Random(5)
    texts = [" ".join(draw.choice("ab") for _ in range(draw.randint(0, 30))) for _ in range(60)]
    line = " ".join("abcdefghijklmnopqrs")
    return texts + ["x " * 50, f"{line} {line}", None, "", " \n", "q w e r t y u i o p l k j", "q w e r t y u i o p l k j", "a b c",
        "k\x01 " * 13 + "k\x00 k", "k k\x1f " * 7, "k\x01 " * 13 + "k"]


@pytest.mark.parametrize("group_rows", [10_000, 40, 10, 1])
def test_odd_rows(spark, group_rows):
    """With ``group_rows`` 1 every group is split down to whole windows."""
    texts = sample()
    found = substring_dedup.remove_repeats(docs(spark, texts), window=12, anchor=4, group_rows=group_rows)
    wanted = brute(dict(enumerate(texts)), 12)
    for r in found.collect():
        assert (r.n_words, r.n_removed) == wanted[r.doc_id][:2]
        assert " ".join(r.kept_text.split()) == wanted[r.doc_id][2]
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
    assert found.count() == len(texts)


def test_a_text_that_repeats_itself_is_no_large_group(spark):
    """Suffixes are counted, not documents: 300 repeats of 40 words are more than a group may hold."""
    stretch = " ".join(f"s{i}" for i in range(40))
    texts = [" ".join([stretch] * 300 + [f"tail{n}"]) for n in range(3)] + ["other " * 50, stretch + " end"]
    rows = docs(spark, texts)
    listed = substring_dedup._scan(substring_dedup.narrow(rows, "doc_id", "text"), 35, 8).where("id = 0").first()
    assert sum(listed.suffixes) == 300 * 40 + 1 - 34 and max(listed.suffixes) > 1_000
    wanted = brute(dict(enumerate(texts)), 35)
    for group_rows in (10, 100_000):
        for r in substring_dedup.remove_repeats(rows, group_rows=group_rows).collect():
            assert (r.n_words, r.n_removed, " ".join(r.kept_text.split())) == wanted[r.doc_id]


def test_a_text_that_says_one_thing_over_and_over_gives_few_leaves(spark):
    """Places with the same words around them go on once per document; all of them are marked there."""
    import zstandard

    words = " ".join([" ".join(f"s{i}" for i in range(40))] * 300 + ["tail"]).encode()
    found = substring_dedup.Suffixes(35, 8)
    first, sizes, anchors = found.runs(found.ids(words.split()))
    frequent = [int(a) for a in set(anchors.astype("int64").tolist())]
    row = [(1, 2, bytearray(zstandard.compress(words)), frequent, frequent)]
    texts = spark.createDataFrame(row, "id long, part long, packed binary, shared array<long>, frequent array<long>")
    rows = substring_dedup._suffix_rows(texts, 35, 8).collect()
    leaves = [leaf for r in rows for leaf in r.leaves or []]
    assert len(leaves) < 20 and sum(leaf.places for leaf in leaves) == len(first) > 300
    marked = [r.marks for r in rows if r.marks]
    assert len(marked) == 1 and sum(m.last - m.first + 1 for m in marked[0]) >= sum(sizes) - 80


def test_a_subtree_marks_what_lies_below_deep_nodes():
    words = b"a b c d e f a b c d x"
    assert substring_dedup._deep([(0, 8, words)], 4) == [[0, 6]]
    assert substring_dedup._deep([(5, 2, b"a b c d e"), (9, 2, b"z b c d e")], 4) == [[1], [1]]
    assert substring_dedup._deep([(0, 1, b"a bc"), (3, 1, b"ab c")], 2) == [[], []]


def test_long_and_empty(spark):
    found = substring_dedup.remove_repeats(docs(spark, [LONG, "short"])).collect()
    assert sorted(r.n_removed for r in found) == [0, 60_000]
    assert substring_dedup.remove_repeats(empty(spark)).count() == 0


def test_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    wanted = brute(texts, 35)
    for r in op8_substring_dedup(spark, FOLDER).collect():
        n, removed, kept = wanted[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, removed, hashlib.sha256(kept.encode()).hexdigest())


def test_rows_without_an_id_take_part(spark):
    """A passage shared with a row that has no id goes from both, and so does one that two such rows share."""
    said = [" ".join(f"{name}{i}" for i in range(40)) for name in "pq"]
    texts = [(1, f"one {said[0]}"), (None, f"{said[0]} two {said[1]}"), (None, f"three {said[1]}"), (None, "four")]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    found = substring_dedup.remove_repeats(rows).collect()
    assert sorted((r.doc_id or 0, r.kept_text, r.n_removed) for r in found) == [
        (0, "four", 0), (0, "three", 40), (0, "two", 80), (1, "one", 40),
    ]
