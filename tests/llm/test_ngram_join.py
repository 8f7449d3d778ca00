import hashlib
import random
from collections import Counter, defaultdict

import pytest

from leafmill.llm import ngram_join
from leafmill.llm.queries import op5_ngram_join
from tests.llm.helpers import LONG, components, docs, empty

FOLDER = "/root/testdata/sf0.001"
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingles(text, words):
    found = (text or "").encode().translate(LOWER).split()
    n = min(words, len(found))
    return {tuple(found[i : i + n]) for i in range(len(found) - n + 1)} if found else set()


def brute(texts, words, percent):
    sets = {i: shingles(t, words) for i, t in texts.items()}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    links = []
    for i, s in sets.items():
        shared = Counter(j for x in s for j in holders[x] if j > i)
        links += [(i, j) for j, n in shared.items() if 100 * n >= percent * (len(s) + len(sets[j]) - n)]
    root = components(links, list(texts))
    return {i: (len(sets[i]), root[i]) for i in texts}


def copies(seed):
    """Groups of edited copies, and texts that share a long passage."""
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(16):
        base = [draw.choice(words) for _ in range(draw.randint(1, 90))]
        for _ in range(draw.randint(1, 12)):
            text = list(base)
            for _ in range(draw.randint(0, 4)):
                text[draw.randrange(len(text))] = draw.choice(words)
            texts.append(" ".join(text))
    passage = [draw.choice(words) for _ in range(60)]
    texts += [" ".join([draw.choice(words) for _ in range(draw.randint(5, 40))] + passage) for _ in range(30)]
    return texts


ODD = [None, "", " \n", "A b", "a B", "a", "a", LONG, LONG + " end", "é É", "é É"]


@pytest.mark.parametrize("words, percent", [(3, 90), (5, 80)])
def test_copies_and_odd_rows(spark, words, percent, monkeypatch):
    monkeypatch.setattr(ngram_join, "PAIRS_PER_MEMBER", 0)  # more leaders, then blocks
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    texts = copies(words) + ODD
    found = ngram_join.link(docs(spark, texts), words=words, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute(dict(enumerate(texts)), words, percent)


def test_empty_table(spark):
    assert ngram_join.link(empty(spark)).count() == 0


def test_no_link_is_lost_over_repeated_and_null_ids(spark):
    """Each row is a document: the other text of an id links too, and so does a row without an id."""
    words = [f"w{i}" for i in range(60)]
    base, near, far = " ".join(words), " ".join(words[:-1]), " ".join(words[:-2])
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(5, base), (5, other), (9, other + " x"), (None, near), (12, far), (None, "alone here"), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.digest: r for r in ngram_join.link(frame, percent=90).collect()}
    of = {t: found[hashlib.md5((t or "").encode()).digest()] for _, t in rows}
    assert [of[t].component_id for _, t in rows] == [5, 5, 5, 5, 5, None, None]
    assert of[base].component == of[near].component == of[far].component != of[other].component == of[other + " x"].component
    assert of["alone here"].component is not None and of[None].component is None


def test_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in op5_ngram_join(spark, FOLDER).collect()}
    assert found == brute(texts, 3, 90)


def test_bound_is_never_below_the_overlap():
    draw = random.Random(1)
    import numpy as np

    for _ in range(300):
        pool = np.array([draw.getrandbits(64) for _ in range(draw.randint(2, 200))], np.uint64)
        a, b = (np.unique(pool[[draw.randrange(len(pool)) for _ in range(draw.randint(1, len(pool)))]]) for _ in "ab")
        bound = ngram_join.overlap_bound(ngram_join.bitmap(a), len(a), ngram_join.bitmap(b), len(b))
        assert bound >= len(np.intersect1d(a, b))


@pytest.mark.parametrize("file_rows", [250_000, 10])
def test_components_of_few_and_many_links(spark, monkeypatch, file_rows):
    """Up to ``FILE_ROWS`` links are followed in one partition; the result is the same."""
    from leafmill.llm import components as module

    monkeypatch.setattr(module, "FILE_ROWS", file_rows)
    draw = random.Random(3)
    links = [(draw.randrange(400), draw.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7)]
    rows = spark.createDataFrame(links, "a long, b long").repartition(3)
    wanted = {i: r for i, r in components(links, sorted({x for pair in links for x in pair})).items() if i != r}
    assert {r.id: r.root for r in module.components(rows).collect()} == wanted
    assert module._few(rows, len(links)).rdd.getNumPartitions() == (1 if len(links) <= file_rows else 3)


def test_only_texts_of_listed_pairs_move(spark):
    """The text of a set in no pair is left out before texts are dealt out for the comparison."""
    import zstandard

    said = ["a b c d e", "a b c d e f", "never asked", "a b c d e"]
    rows = [(i, bytearray(zstandard.compress(t.encode()))) for i, t in enumerate(said)]
    texts = spark.createDataFrame(rows, "id long, packed binary")
    pairs = spark.createDataFrame([(0, 1), (0, 3)], "a long, b long")
    found = ngram_join._linked(pairs, texts, 3, 90)
    assert [tuple(r) for r in found.collect()] == [(0, 3)]
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.id for r in ngram_join._named(pairs).collect()) == [0, 1, 3]
