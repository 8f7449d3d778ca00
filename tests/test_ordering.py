"""The ways for small and for large groups must give the same rows."""

import random

import pytest
from pyspark.sql import functions as F

from leafmill.operators import convert, layout, tokens
from leafmill.operators.ordering import arrange

SMALL = 10**9  # no group is larger
LARGE = 10  # one group is


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one group, many groups with few rows."""
    random.seed(5)
    rows = [(0 if i % 3 == 0 else i % 40, random.randrange(20), i) for i in range(3_000)]
    rows += [(None, 1, 5_000 + i) for i in range(30)]
    return spark.createDataFrame(rows, "k int, v int, ix long").repartition(7)


def run(df, rows, slice_rows):
    ordered = arrange(df, ["k"], [F.col("v").desc(), F.col("ix")], "rank", rows, slice_rows)
    return ordered.lag({"before": "v"}).running_total(F.col("v"), "total")


@pytest.mark.parametrize("slice_rows", [1, 7, 64, 10_000])
def test_ranks_lags_totals(skewed, slice_rows):
    small, large = run(skewed, SMALL, slice_rows), run(skewed, LARGE, slice_rows)
    assert not small.large and large.large
    columns = ["k", "v", "ix", "rank", "before", "total"]
    expected = sorted(map(repr, small.df.select(*columns).collect()))
    assert sorted(map(repr, large.df.select(*columns).collect())) == expected


def test_global_numbers(skewed):
    rows = arrange(skewed, [], [F.col("ix")], "n", group_rows=10).df.orderBy("ix").collect()
    assert [r["n"] for r in rows] == list(range(1, len(rows) + 1))


def test_parts_hold_the_whole_text(skewed):
    rows = arrange(skewed, ["k"], [F.col("ix")], "rank", LARGE)
    parts = rows.texts({"t": F.concat(F.col("ix").cast("string"), F.lit(" "))}, part_rows=50)
    found = {}
    for r in sorted(parts.collect(), key=lambda r: (r["k"] is None, r["k"] or 0, r["part"])):
        assert r["rows"] <= 50
        found[r["k"]] = found.get(r["k"], "") + r["t"]
    wanted = {}
    for r in skewed.orderBy("ix").collect():
        wanted[r["k"]] = wanted.get(r["k"], "") + f"{r['ix']} "
    assert found == wanted


@pytest.fixture(scope="module")
def regions(spark):
    random.seed(11)
    rows = []
    for i in range(1_200):
        page = 1 if i % 3 == 0 else i % 60
        x, y = random.randrange(300) * 1.0, random.randrange(60) * 10.0
        w, h = random.choice([10.0, 40.0, 90.0, 600.0]), random.choice([0.0, 20.0, 30.0])
        vertical = random.random() < 0.4
        rows.append(
            (page, i, x, y, x + w, y + h, random.randrange(10) / 10, vertical,
             90 if vertical else 0, random.choice(["", "ab", "c", "日本"]))
        )
    rows += [(1, 5_000 + i, 5.0, 5.0, 45.0, 25.0, 0.9, False, 0, "copy") for i in range(300)]
    schema = (
        "page_id int, ix long, x1 double, y1 double, x2 double, y2 double, confidence double,"
        " is_vertical boolean, direction int, text string"
    )
    return spark.createDataFrame(rows, schema)


def iou(a, b):
    w = min(a.x2, b.x2) - max(a.x1, b.x1)
    h = min(a.y2, b.y2) - max(a.y1, b.y1)
    if w <= 0 or h <= 0:
        return 0.0
    union = (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - w * h
    return w * h / union if union > 0 else 0.0


def by_page(regions):
    pages = {}
    for r in regions.collect():
        pages.setdefault(r.page_id, []).append(r)
    return pages


@pytest.mark.parametrize("threshold", [0.1, 0.5])
@pytest.mark.parametrize("page_boxes", [10**9, 30])
def test_suppression_against_brute_force(regions, threshold, page_boxes):
    wanted = set()
    for page, boxes in by_page(regions).items():
        kept = []
        for b in sorted(boxes, key=lambda r: (-r.confidence, r.ix)):
            if all(iou(k, b) <= threshold for k in kept):
                kept.append(b)
        wanted |= {(page, b.ix) for b in kept}
    found = layout.suppress(regions, threshold, page_boxes).collect()
    assert len(found) == len(wanted)
    assert {(r.page_id, r.ix) for r in found} == wanted


def test_overlaps_against_brute_force(regions):
    wanted = 0
    for boxes in by_page(regions).values():
        for i, a in enumerate(boxes):
            wanted += sum(iou(a, b) > 0.2 for b in boxes[i + 1 :])
    found = layout.overlaps(regions, 0.2).collect()
    pairs = sum(
        r.copies_a * (r.copies_a - 1) // 2 if r.ix_a == r.ix_b else r.copies_a * r.copies_b
        for r in found
    )
    assert pairs == wanted


def test_boxes_of_all_sizes_meet(spark):
    """Long and high, tiny and large boxes, on the borders of tiles and below zero."""
    draw = random.Random(7)
    sides = [0.01, 1.0, 2.0, 3.7, 64.0, 500.0]
    rows = []
    for ix in range(160):
        x, y, w, h = draw.uniform(-300, 300), draw.uniform(-300, 300), draw.choice(sides), draw.choice(sides)
        if ix % 3 == 0:
            x, y = float(round(x)), float(round(y / 64) * 64)
        rows.append((ix % 2, ix, x, y, x + w, y + h))
    frame = spark.createDataFrame(rows, "page_id int, ix int, x1 double, y1 double, x2 double, y2 double")
    boxes = frame.collect()
    for least in (0.0, 0.3):
        wanted = {
            (a.ix, b.ix) for a in boxes for b in boxes
            if a.page_id == b.page_id and a.ix < b.ix and iou(a, b) > least
        }
        got = [(r.ix_a, r.ix_b) for r in layout.overlaps(frame, least).collect()]
        assert len(got) == len(set(got)) and set(got) == wanted


@pytest.mark.parametrize("page_boxes", [0, 12, 256])
def test_pages_in_one_row_and_tiled_pages_agree(spark, page_boxes, monkeypatch):
    """Pages of 20, 10 and 5 boxes (the last without an id), with piles and boxes without area."""
    draw = random.Random(11)
    rows = []
    for page, n in ((1, 20), (2, 10), (None, 5)):
        for ix in range(n):
            x, y, w = draw.uniform(-9, 9), draw.uniform(-9, 9), draw.choice([0.0, 0.3, 5.0, 12.0])
            rows.append((page, ix, x, y, x + w, y + draw.choice([0.3, 4.0, 9.0])))
        rows += [(page, 100 + ix, 0.0, 0.0, 2.0, 2.0) for ix in range(3)]
    rows.append((3, 0, 0.0, 0.0, 2.0, 2.0))
    frame = spark.createDataFrame(rows, "page_id int, ix int, x1 double, y1 double, x2 double, y2 double")
    tiled, real = [], layout._placed
    monkeypatch.setattr(layout, "_placed", lambda boxes, least: tiled.append(boxes.select("page_id").distinct().count()) or real(boxes, least))
    for least in (0.0, 0.2, 1.0):
        piled = {(r.page_id, *r[2:]): r for r in reversed(frame.collect())}.values()
        copies = lambda a: 3 if a.ix == 100 else 1
        wanted = {
            (a.page_id, a.ix, b.ix, copies(a), copies(b), round(iou(a, b), 9)) for a in piled for b in piled
            if a.page_id == b.page_id and (a.ix < b.ix or (a is b and copies(a) > 1)) and iou(a, b) > least
        }
        got = [(*r[:5], round(r.iou, 9)) for r in layout.overlaps(frame, least, page_boxes).collect()]
        assert len(got) == len(set(got)) and set(got) == wanted
    assert tiled == {0: [4] * 3, 12: [2] * 3, 256: []}[page_boxes]


def test_many_boxes_in_a_small_place_spread_over_tiles(spark):
    """20,000 small boxes on 256 pixels: few rows a box, and few boxes a tile."""
    places = spark.range(20_000).selectExpr("1 as page_id", "id as ix", "(id % 141) * 1.8 as x1", "floor(id / 141) * 1.8 as y1")
    boxes = places.selectExpr("*", "x1 + 1.5 + (ix % 3) * 0.2 as x2", "y1 + 1.5 as y2")
    placed = layout._placed(boxes, 0.0)
    tiles = placed.groupBy("gx", "gy", "tx", "ty").count()
    assert placed.count() <= 4 * 20_000 * placed.select("gx", "gy").distinct().count()
    assert tiles.agg({"count": "max"}).first()[0] <= 9


def markdown(boxes):
    """Page text by walking the boxes one by one."""
    vertical = sum(b.is_vertical for b in boxes)
    upright = vertical > len(boxes) - vertical
    boxes = sorted(boxes, key=lambda b: (-b.x1, b.y1, b.ix) if upright else (b.y1, b.x1, b.ix))
    out, y, direction = "", float("-inf"), 0
    for b in boxes:
        if out and abs(b.y1 - y) > 50:
            out += "\n\n"
        elif out and abs(b.y1 - y) <= 50 and direction != b.direction:
            out += "\n"
        out, y, direction = out + b.text, b.y1, b.direction
    return out


@pytest.mark.parametrize("rows", [SMALL, LARGE])
def test_markdown_against_a_walk(regions, rows):
    found = {r.page_id: r.markdown for r in layout.page_markdown(regions, group_rows=rows).collect()}
    assert found == {p: markdown(b) for p, b in by_page(regions).items()}


@pytest.mark.parametrize("rows", [SMALL, LARGE])
def test_paragraphs_against_a_walk(regions, rows):
    wanted = {}
    for page, boxes in by_page(regions).items():
        number, y = 0, None
        for b in sorted(boxes, key=lambda b: b.ix):
            number += y is not None and abs(b.y1 - y) > 30
            wanted[(page, b.ix)] = number
            y = b.y1
    found = layout.paragraphs(regions, 30.0, group_rows=rows).df.collect()
    assert {(r.page_id, r.ix): r.paragraph for r in found} == wanted
    texts = layout.paragraph_texts(regions, 30.0, group_rows=rows)
    assert texts.agg(F.sum("rows")).first()[0] == len(wanted)


def test_lines(regions):
    small = layout.line_texts(regions, group_rows=SMALL).collect()
    large = layout.line_texts(regions, group_rows=LARGE).collect()
    assert sorted(small) == sorted(large)


@pytest.mark.parametrize("rows", [SMALL, 5])
@pytest.mark.parametrize("standard", [False, True])
def test_decoding_against_a_walk(spark, rows, standard):
    random.seed(3)
    entries = [(0, "_"), (1, "a"), (2, "b"), (4, "")]
    lines = {
        line: [[random.choice([-0.5, 0.0, 0.25, 0.75]) for _ in range(5)] for _ in range(line * 4)]
        for line in range(1, 9)
    }
    lines[99] = [[-1.0] * 5]
    data = [(n, t, p) for n, steps in lines.items() for t, p in enumerate(steps)]
    steps = spark.createDataFrame(data, "line_id int, t long, probs array<float>")
    known = dict(entries)
    wanted = {}
    for n, probabilities in lines.items():
        text, total, last = "", 0.0, -1
        for p in probabilities:
            best, at = 0.0, 0
            for c, v in enumerate(p):
                if v > best:
                    best, at = v, c
            if at > 0 and at in known and at != last:
                text, total, last = text + known[at], total + best, at
            elif standard and not (at > 0 and at in known):
                last = at
        wanted[n] = (text, round(total / len(probabilities), 6) if text else 0.0)
    dictionary = spark.createDataFrame(entries, "id int, token string")
    found = tokens.ctc_decode(steps, dictionary, standard=standard, group_rows=rows).collect()
    assert {r.line_id: (r.text, round(r.confidence, 6)) for r in found} == wanted


def test_transitions(spark):
    log = spark.createDataFrame(
        [(b, t, t, s) for b in (1, 2) for t, s in enumerate(["pending", "processing", "completed", "failed"] * 5)],
        "book_id int, updated_at long, seq long, status string",
    )
    small = convert.progress_transitions(log, group_rows=SMALL).collect()
    large = convert.progress_transitions(log, group_rows=5).collect()
    assert sorted(small) == sorted(large)
    assert [r.allowed for r in sorted(small, key=lambda r: (r.book_id, r.step))[:5]] == [
        True, True, True, False, True,
    ]


def test_a_large_book_is_ranked_without_its_texts(spark, monkeypatch):
    """Only numbers are sorted by range; the texts are the same as those of small books."""
    from leafmill.operators import layout

    rows = [(b, p, p, f"text {b} {p}") for b in ("x", "y", None) for p in range(1, 8)]
    pages = spark.createDataFrame(rows, "book_id string, page_number int, id long, t string")
    seen, real = [], layout.arrange
    monkeypatch.setattr(layout, "arrange", lambda df, *a, **k: seen.append(df.columns) or real(df, *a, **k))
    found = [sorted(map(str, layout.book_document(pages, "t", 3, group_rows=n).collect())) for n in (100, 2)]
    assert found[0] == found[1] and len(found[0]) == 9
    assert "t" in seen[0] and "t" not in seen[1]
