"""Vector codes against a plain search and plain means."""

import hashlib
import math
import random

import numpy as np
import pytest

from leafmill.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error long, vector int, cell int"


def expected(rows: list[tuple], entries: int, rounds: int) -> list[tuple]:
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = max(1, -(-max((len(r[1]) for r in kept), default=0) // 4))
    limit = vector_codes.LIMIT
    ints = [[max(-limit, min(limit, math.floor(np.float32(x).item() * 1024))) for x in r[1]] for r in kept]
    ints = [v + [0] * (4 * width - len(v)) for v in ints]
    parts = [[v[p * width : (p + 1) * width] for v in ints] for p in range(4)]
    books = [part[:entries] for part in parts]

    def nearest(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(book))

    for _ in range(rounds):
        for p in range(4):
            members: dict = {}
            for v in parts[p]:
                members.setdefault(nearest(v, books[p])[1], []).append(v)
            books[p] = [[sum(x) // len(members[i]) for x in zip(*members[i])] if i in members else c for i, c in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out, sums = [], {}
    for n, r in enumerate(kept):
        found = [nearest(parts[p][n], books[p]) for p in range(4)]
        error = sum(f[0] for f in found)
        sums[r[2]] = sums.get(r[2], 0) + error
        out.append((r[0], "".join(f"{f[1]:02x}" for f in found), error, r[2]))
    return sorted(((i, code, error, sums[label], digest) for i, code, error, label in out), key=repr)


def got(spark, rows, entries=256, rounds=4):
    frame = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in vector_codes.compress(frame, entries=entries, rounds=rounds).collect()), key=repr)


def vectors(n: int, width: int, steps: int) -> list[tuple]:
    dice = random.Random(n)
    return [(i * 3, [dice.randrange(-steps, steps) / 64 for _ in range(width)], dice.choice([None, 1, 2])) for i in range(n)]


@pytest.mark.parametrize("n, width, steps, entries", [(300, 8, 20, 16), (200, 12, 3, 64), (40, 4, 100, 256)])
def test_brute_force(spark, n, width, steps, entries):
    rows = vectors(n, width, steps)
    assert got(spark, rows, entries) == expected(rows, entries, 4)


def test_odd_rows(spark):
    rows = [
        (1, [0.5, 0.25, -0.1, 3.0], 1), (1, [0.5, 0.25, -0.1, 3.0], 1), (1, [0.5, 0.0, -0.1, 3.0], None), (None, [1.0, 1.0, 1.0, 1.0], None),
        (2, None, 1), (3, [1.0, None, 1.0, 1.0], 1), (4, [1.0, float("nan"), 1.0, 1.0], 1), (5, [float("inf"), 1.0, 1.0, 1.0], 1),
        (6, [], 2), (7, [1.0], 2), (8, [1.0] * 9, 2), (9, [3e38, -3e38, 0.0, 0.0], 3),
    ]
    for entries in (2, 256):
        assert got(spark, rows, entries) == expected(rows, entries, 4)


def test_no_usable_rows(spark):
    assert got(spark, []) == [] and got(spark, [(1, None, 1)]) == []


def test_orchard_finds_the_lowest_of_equal_entries():
    dice = np.random.default_rng(5)
    for k in (1, 2, 7, 60):
        entries = dice.integers(-4, 5, (k, 3))
        entries[k // 2 :] = entries[: k - k // 2]
        points = dice.integers(-6, 7, (500, 3))
        index, distance = vector_codes.Orchard(entries).nearest(points)
        plain = np.square(points[:, None] - entries[None]).sum(2)
        assert (index == plain.argmin(1)).all() and (distance == plain.min(1)).all()
