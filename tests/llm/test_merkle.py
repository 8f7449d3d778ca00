"""Merkle manifest: brute force over trees of many shapes, slices of several sizes."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from leafmill.llm import merkle
from leafmill.llm.queries import LOWER, MANIFEST_COLUMNS, UPPER
from tests.llm.helpers import LONG

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, pos long, digest string, slice int"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row: tuple) -> str:
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def climb(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """Root, and the path of each node."""
    paths: list[list[tuple[str, str]]] = [[] for _ in nodes]
    owners = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, upper = [], []
        for start in range(0, len(nodes), 8):
            run = nodes[start : start + 8]
            for k in range(len(run)):
                for i in owners[start + k]:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(sha("".join(run)))
            upper.append(sum(owners[start : start + 8], []))
        nodes, owners = up, upper
    return nodes[0], paths


def expected(rows: list[tuple]) -> list[tuple]:
    trees: dict = {}
    for row in rows:
        trees.setdefault(row[2], []).append(row)
    order = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    built = {}
    for tree in order:
        ordered = sorted(trees[tree], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        built[tree] = (ordered, *climb([leaf(r) for r in ordered]))
    root, tops = climb([built[t][1] for t in order])
    out = []
    for tree, top in zip(order, tops):
        ordered, subroot, paths = built[tree]
        for row, path in zip(ordered, paths):
            whole = path + top
            changed = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[4] is not None:
                changed = (*row[:4], row[4].translate(str.maketrans(UPPER, LOWER)))
            node = leaf(changed)
            for left, right in whole:
                node = sha(left + node + right)
            proof = sha("".join(a + b for a, b in whole))
            out.append((row[0], leaf(row), subroot, root, proof, node, node == root))
    return sorted(out, key=repr)


def found(spark, rows: list[tuple], levels: int) -> list[tuple]:
    docs = spark.createDataFrame([(*r, "x", 7, "y", 1) for r in rows], SCHEMA)
    lowered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    made = merkle.manifest(docs, MANIFEST_COLUMNS, tampered={"text": lowered}, levels=levels)
    made = made.select(
        "doc_id", "leaf", "subroot", "root",
        merkle.proof(F.col("path")).alias("proof"), merkle.fold(F.col("path"), F.col("tampered_leaf")).alias("folded"),
    )
    return sorted((tuple(r) for r in made.withColumn("ok", F.col("folded") == F.col("root")).collect()), key=repr)


def table(sizes: dict) -> list[tuple]:
    dice = random.Random(3)
    rows = []
    for lang, n in sizes.items():
        rows += [(dice.randrange(10**6), f"s{i % 3}", lang, i, f"Text {i} of {lang}") for i in range(n)]
    dice.shuffle(rows)
    return rows


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_shapes(spark, levels):
    rows = table({"en": 150, "de": 65, "fr": 64, "es": 9, "it": 8, "pt": 1, None: 7, "": 2, "é": 1, "-": 1})
    assert found(spark, rows, levels) == expected(rows)


def test_odd_rows(spark):
    rows = [
        (None, None, None, None, None), (None, "s", "en", 1, "A"), (5, "s", "en", None, None), (5, "s", "en", 1, ""),
        (5, "s", "en", 1, ""), (6, "s", "en", 1, "Ünïcode Ä"), (7, "s", "en", -3, LONG), (8, "", "de", 0, "5:x-"),
    ]
    assert found(spark, rows, 1) == expected(rows)


@pytest.mark.parametrize("rows", [[], [(1, "s", "en", 2, "One")], [(1, "s", "en", 2, "One"), (2, "s", None, 2, "Two")]])
def test_small_tables(spark, rows):
    assert found(spark, rows, 2) == (expected(rows) if rows else [])


def test_tampering_is_found(spark):
    rows = [(i, "s", "en", 1, "Upper" if i % 2 else "lower") for i in range(40)]
    for doc_id, *_, ok in found(spark, rows, 4):
        picked = zlib.crc32(str(doc_id).encode()) % 3 == 0
        assert ok == (not (picked and doc_id % 2))
