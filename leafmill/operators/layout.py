"""Text boxes on pages: detection, overlap, suppression, reading order, text."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import geometry
from leafmill.operators.joins import broadcast_if_small
from leafmill.operators.ordering import (
    GROUP_ROWS,
    TEXT_GROUP_ROWS,
    Arranged,
    arrange,
    has_large_group,
    match,
)
from leafmill.session import keep

# Vertical gap that starts a paragraph.
PARAGRAPH_GAP = 50.0

# Pages with more boxes than this are suppressed box by box over the cluster.
PAGE_BOXES = 2_000

# Pages with more regions than this are tiled, and their boxes compared over the cluster.
PAIR_BOXES = 256

# Boxes below 2 to this power wide or high share a level.
LEAST_LEVEL = -30


def detector_boxes(
    tensors: DataFrame, keys: Sequence[str], confidence: float = geometry.CONFIDENCE
) -> DataFrame:
    """Boxes ``(ix, x1, y1, x2, y2, confidence)`` of raw detector output.

    ``shape`` must be [1, boxes, values]; a box has 4 values or 5 with its
    confidence (else 1). Other shapes give no boxes. Boxes are built and filtered
    inside the row, so the tensor itself is never copied per box.
    """
    stride, boxes = F.get("shape", F.lit(2)), F.get("shape", F.lit(1))
    data = F.col("data")

    def box(i: Column) -> Column:
        base = i * stride

        def value(n: int) -> Column:
            return F.get(data, (base + n).cast("int")).cast("double")

        scored = (stride >= 5) & (base + 4 < F.size(data))
        return F.struct(
            i.cast("int").alias("ix"),
            value(0).alias("x1"), value(1).alias("y1"), value(2).alias("x2"), value(3).alias("y2"),
            F.when(scored, value(4)).otherwise(F.lit(1.0)).alias("confidence"),
        )

    good = F.when(F.size("shape") == 3, F.get("shape", F.lit(0)) == 1).otherwise(F.lit(False))
    complete = F.filter(
        F.sequence(F.lit(0), boxes - 1), lambda i: i * stride + 3 < F.size(data)
    )
    found = F.filter(F.transform(complete, box), lambda b: b["confidence"] > confidence)
    usable = tensors.filter(good).filter((boxes > 0) & (stride >= 4))
    return usable.select(*keys, F.inline(found))


def rescale_boxes(boxes: DataFrame) -> DataFrame:
    """Boxes in image pixels with crop size, recognition width and validity.

    ``boxes`` has the box, ``image_width`` and ``image_height``. A box that ends
    before it starts cannot be cropped; it is marked instead of wrapping around.
    """
    placed = geometry.rescaled(geometry.columns(), F.col("image_width"), F.col("image_height"))
    moved = boxes.withColumns({f"px_{n}": c for n, c in placed.items()})
    width = F.col("px_x2") - F.col("px_x1") + 1
    height = F.col("px_y2") - F.col("px_y1") + 1
    valid = (width > 0) & (height > 0)
    return moved.withColumns({"valid": valid, "crop_width": F.greatest(width, F.lit(1)),
                              "crop_height": F.greatest(height, F.lit(1))}).withColumn(
        "line_width", geometry.line_width(F.col("crop_width"), F.col("crop_height"))
    )


def confident(regions: DataFrame, threshold: float = geometry.CONFIDENCE) -> DataFrame:
    return regions.filter(F.col("confidence") > threshold)


def page_confidence(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean confidence of the non-empty lines of each page; 0 if there are none."""
    scored = F.when(F.col("text") != "", F.col("confidence"))
    return lines.groupBy(*keys).agg(F.coalesce(F.avg(scored), F.lit(0.0)).alias("confidence"))


def reading_votes(regions: DataFrame, key: str = "page_id") -> DataFrame:
    """Reading order of each page by majority; a tie is ``Mixed``. An unknown direction counts as horizontal."""
    upright = F.coalesce("is_vertical", F.lit(False))
    votes = regions.groupBy(key).agg(
        F.count_if(upright).alias("vertical"), F.count_if(~upright).alias("horizontal")
    )
    return votes.withColumn("reading_order", _order(F.col("vertical"), F.col("horizontal")))


def _order(vertical: Column, horizontal: Column) -> Column:
    return (
        F.when(vertical > horizontal, "Vertical").when(horizontal > vertical, "Horizontal")
        .otherwise("Mixed")
    )


def in_reading_order(
    regions: DataFrame,
    key: str = "page_id",
    group_rows: int = GROUP_ROWS,
    large: bool | None = None,
) -> Arranged:
    """Regions with ``rank`` in the reading order of their page.

    Vertical pages run right to left and then down, others down and then left to
    right; equal places keep input order (``ix``).
    """
    if large is None:
        large = has_large_group(regions, [key], group_rows)
    if large:
        voted = match(regions, reading_votes(regions, key).select(key, "reading_order"), [key], "inner")
    else:
        page = Window.partitionBy(key)
        vertical = F.count_if(F.coalesce("is_vertical", F.lit(False))).over(page)
        total = F.count(F.lit(1)).over(page)
        voted = regions.withColumn("reading_order", _order(vertical, total - vertical))
    upright = F.col("reading_order") == "Vertical"
    placed = voted.withColumns(
        {
            "_major": F.when(upright, -F.col("x1")).otherwise(F.col("y1")),
            "_minor": F.when(upright, F.col("y1")).otherwise(F.col("x1")),
        }
    )
    order = [F.col("_major"), F.col("_minor"), F.col("ix")]
    return arrange(placed, [key], order, "rank", group_rows, large=large)


def paragraphs(
    regions: DataFrame, threshold: float, key: str = "page_id", group_rows: int = GROUP_ROWS
) -> Arranged:
    """Regions in input order with ``paragraph`` counting from 0 on each page."""
    rows = arrange(regions, [key], [F.col("ix")], "rank", group_rows).lag({"_y": "y1"})
    starts = F.coalesce((F.abs(F.col("y1") - F.col("_y")) > threshold).cast("int"), F.lit(0))
    counted = rows.running_total(starts, "paragraph")
    return counted.with_df(counted.df.drop("_y"))


def paragraph_texts(
    regions: DataFrame, threshold: float, key: str = "page_id", group_rows: int = GROUP_ROWS
) -> DataFrame:
    """Text and region count of each paragraph, with single spaces between regions."""
    rows = paragraphs(regions, threshold, key, group_rows)
    inner = rows.lag({"_before": "paragraph"}).df
    same = F.col("_before").eqNullSafe(F.col("paragraph"))
    piece = F.concat(F.when(same, F.lit(" ")).otherwise(F.lit("")), F.col("text"))
    return Arranged(inner, (key, "paragraph"), "rank", rows.large).texts({"text": piece})


def page_markdown(
    regions: DataFrame,
    key: str = "page_id",
    gap: float = PARAGRAPH_GAP,
    group_rows: int = GROUP_ROWS,
    large: bool | None = None,
    sums: dict[str, Column] | None = None,
) -> DataFrame:
    """Markdown of each page in reading order.

    A gap above ``gap`` starts a paragraph, otherwise a change of direction
    starts a line, otherwise texts join directly; nothing is put before the
    first text. The output is still empty exactly while no earlier text was
    non-empty.
    """
    rows = in_reading_order(regions, key, group_rows, large).lag({"_y": "y1", "_direction": "direction"})
    rows = rows.running_total((F.length("text") > 0).cast("int"), "_texts")
    empty = F.col("_texts") - (F.length("text") > 0).cast("int") == 0
    far = F.col("_y").isNull() | (F.abs(F.col("y1") - F.col("_y")) > gap)
    turned = F.coalesce("_direction", F.lit(0)) != F.col("direction")
    separator = (
        F.when(empty, F.lit("")).when(far, F.lit("\n\n")).when(turned, F.lit("\n")).otherwise(F.lit(""))
    )
    return rows.texts({"markdown": F.concat(separator, F.col("text"))}, sums=sums)


def line_texts(
    regions: DataFrame, key: str = "page_id", group_rows: int = GROUP_ROWS
) -> DataFrame:
    """Lines of a page in input order: joined by line breaks, and by spaces."""
    rows = arrange(regions, [key], [F.col("ix")], "rank", group_rows)
    first = F.col("rank") == 1

    def piece(separator: str) -> Column:
        return F.concat(F.when(first, F.lit("")).otherwise(F.lit(separator)), F.col("text"))

    return rows.texts({"markdown": piece("\n"), "plain_text": piece(" ")})


def book_document(
    pages: DataFrame, text: str, part_pages: int = 64, group_rows: int = TEXT_GROUP_ROWS
) -> DataFrame:
    """Each book as one document in parts of at most ``part_pages`` pages.

    Pages come in order, each followed by a separator naming its number. Where a book is large, pages are ranked without
    their texts; ``page_number`` and ``id`` together tell the pages of a book apart.
    """
    order = [F.col("page_number"), F.col("id")]
    large = has_large_group(pages, ["book_id"], group_rows)
    if large:
        numbers = arrange(pages.select("book_id", "page_number", "id"), ["book_id"], order, "rank", large=True)
        rows = numbers.with_df(match(pages, numbers.df, ["book_id", "page_number", "id"], "inner"))
    else:
        rows = arrange(pages, ["book_id"], order, "rank", large=False)
    separator = F.format_string("\n\n--- Page %d ---\n\n", F.col("page_number"))
    return rows.texts({"document": F.concat(F.col(text), separator)}, part_pages)


def _placed(boxes: DataFrame, min_iou: float) -> DataFrame:
    """Boxes in the tiles of every grid on which they meet others of their page.

    A box has a level per direction, the power of two that its side just fits into, and two boxes meet on the grid of
    the larger level in either direction. So a box reaches into at most four tiles of a grid, small boxes get small
    tiles, and a page has no more grids than its boxes have pairs of levels. Boxes above ``min_iou`` are alike in size,
    which leaves out grids of much larger ones. Boxes without area are in no tile.
    """
    level = lambda low, high: F.greatest(F.ceil(F.log2(F.col(high) - F.col(low))).cast("int"), F.lit(LEAST_LEVEL))
    sized = boxes.filter("x2 > x1 and y2 > y1").withColumns({"_lx": level("x1", "x2"), "_ly": level("y1", "y2")})
    levels = sized.groupBy("page_id").agg(F.collect_set(F.struct("_lx", "_ly")).alias("_met"))
    alike = F.col("_met")
    if min_iou > 0:
        apart = math.ceil(-math.log2(min_iou)) + 1
        alike = F.filter(alike, lambda m: (F.abs(m["_lx"] - F.col("_lx")) <= apart) & (F.abs(m["_ly"] - F.col("_ly")) <= apart))
    grids = F.transform(alike, lambda m: F.struct(F.greatest(m["_lx"], "_lx").alias("gx"), F.greatest(m["_ly"], "_ly").alias("gy")))
    names = F.struct(*[c for c in boxes.columns if c != "page_id"]).alias("box")
    rows = match(sized, broadcast_if_small(keep(levels)), ["page_id"], "inner")
    rows = rows.withColumn("_grid", F.explode(F.array_distinct(grids))).select(
        "page_id", "_grid.*", (F.col("_lx") == F.col("_grid.gx")).alias("nx"), (F.col("_ly") == F.col("_grid.gy")).alias("ny"), names
    )

    def cells(low: str, high: str, grid: str) -> Column:
        side = F.pow(F.lit(2.0), F.col(grid))
        return F.sequence(F.floor(F.col(f"box.{low}") / side), F.floor(F.col(f"box.{high}") / side))

    return rows.withColumn("tx", F.explode(cells("x1", "x2", "gx"))).withColumn("ty", F.explode(cells("y1", "y2", "gy")))


def _pairs(boxes: DataFrame, min_iou: float, before: Callable[[Column, Column], Column]) -> DataFrame:
    """Overlapping pairs of boxes of a page, structs ``a`` and ``b``, with ``iou``; ``a`` is the one that comes before.

    On a grid only boxes of its own level meet the others, or those of its level in one direction those of its level in
    the other. A pair counts only in the tile that holds the corner of its overlap, so none comes twice.
    """
    placed = keep(_placed(boxes, min_iou))
    tile = ["page_id", "gx", "gy", "tx", "ty"]
    own = F.col("nx") & F.col("ny")
    p = placed.select(*tile, F.col("box").alias("p"), own.alias("p_own"), F.col("nx").alias("p_nx"))
    q = placed.select(*tile, F.col("box").alias("q"), own.alias("q_own"), F.col("ny").alias("q_ny"))
    same_level = match(p.where("p_own"), q, tile, "inner").where(~F.col("q_own") | before(F.col("p"), F.col("q")))
    crossing = match(p.where("p_nx and not p_own"), q.where("q_ny and not q_own"), tile, "inner")
    left, right = geometry.fields(F.col("p")), geometry.fields(F.col("q"))
    x, y = F.greatest(left["x1"], right["x1"]), F.greatest(left["y1"], right["y1"])
    meets = (
        (x < F.least(left["x2"], right["x2"]))
        & (y < F.least(left["y2"], right["y2"]))
        & (F.floor(x / F.pow(F.lit(2.0), F.col("gx"))) == F.col("tx"))
        & (F.floor(y / F.pow(F.lit(2.0), F.col("gy"))) == F.col("ty"))
    )
    found = same_level.unionByName(crossing).filter(meets).withColumn("iou", geometry.iou(left, right)).filter(F.col("iou") > min_iou)
    first = before(F.col("p"), F.col("q"))
    return found.select(
        "page_id", F.when(first, F.col("p")).otherwise(F.col("q")).alias("a"), F.when(first, F.col("q")).otherwise(F.col("p")).alias("b"), "iou"
    )


def _piled(regions: DataFrame) -> DataFrame:
    """Each distinct box with area once, with its first ``ix`` and its number of ``copies``."""
    return regions.filter("x2 > x1 and y2 > y1").groupBy("page_id", "x1", "y1", "x2", "y2").agg(
        F.min("ix").alias("ix"), F.count(F.lit(1)).alias("copies")
    )


def _pair(a: Column, b: Column, iou: Column) -> Column:
    """A result of ``overlaps`` but for its page."""
    return F.struct(
        a["ix"].alias("ix_a"), b["ix"].alias("ix_b"), a["copies"].alias("copies_a"), b["copies"].alias("copies_b"), iou.alias("iou")
    )


def _overlaps_small(regions: DataFrame, min_iou: float) -> DataFrame:
    """Overlapping pairs per page, each box against those after it, within one row."""
    boxes = F.sort_array(F.collect_list(F.struct("ix", "copies", "x1", "y1", "x2", "y2")))
    pages = _piled(regions).groupBy("page_id").agg(boxes.alias("_boxes"))

    def after(p: Column, n: Column) -> Column:
        left = geometry.fields(p)

        def meets(q: Column) -> Column:
            right = geometry.fields(q)
            return (
                (p["ix"] < q["ix"])
                & (left["x1"] < right["x2"]) & (right["x1"] < left["x2"])
                & (left["y1"] < right["y2"]) & (right["y1"] < left["y2"])
            )

        later = F.filter(F.slice("_boxes", n + 2, F.size("_boxes")), meets)
        return F.transform(later, lambda q: _pair(p, q, geometry.iou(left, geometry.fields(q))))

    found = F.filter(F.flatten(F.transform("_boxes", after)), lambda r: r["iou"] > min_iou)
    if min_iou < 1.0:
        piles = F.filter("_boxes", lambda p: p["copies"] > 1)
        found = F.concat(found, F.transform(piles, lambda p: _pair(p, p, F.lit(1.0))))
    return pages.select("page_id", F.inline(found))


def _overlaps_large(regions: DataFrame, min_iou: float) -> DataFrame:
    """The same pairs for pages of any size, box by box."""
    boxes = keep(_piled(regions))
    found = _pairs(boxes, min_iou, lambda p, q: p["ix"] < q["ix"]).select(
        "page_id", F.inline(F.array(_pair(F.col("a"), F.col("b"), F.col("iou"))))
    )
    if min_iou >= 1.0:
        return found
    pile = F.struct("ix", "copies")
    piles = boxes.filter("copies > 1").select("page_id", F.inline(F.array(_pair(pile, pile, F.lit(1.0)))))
    return found.unionByName(piles)


def overlaps(regions: DataFrame, min_iou: float = 0.0, page_boxes: int = PAIR_BOXES) -> DataFrame:
    """Pairs of overlapping boxes on each page with their IoU.

    Regions with the very same box are one box with ``copies``; a box with
    copies also pairs with itself. This says everything about the pairs of
    regions without listing the square of a pile of copies. Pages up to
    ``page_boxes`` regions are compared in one row; larger ones are tiled and
    worked out across tasks with the same result.
    """
    sizes = regions.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))
    large = keep(sizes.filter(F.col("n") > page_boxes).select("page_id"))
    if large.isEmpty():
        return _overlaps_small(regions, min_iou)
    large = broadcast_if_small(large)
    small_pages = match(regions, large, ["page_id"], "left_anti")
    large_pages = match(regions, large, ["page_id"], "left_semi")
    return _overlaps_small(small_pages, min_iou).unionByName(_overlaps_large(large_pages, min_iou))


def _suppress_small(regions: DataFrame, threshold: float) -> DataFrame:
    """Greedy suppression per page, as a fold over its boxes from best to worst."""
    names = [c for c in regions.columns if c != "page_id"]
    row = F.struct((-F.col("confidence")).alias("_key"), F.col("ix").alias("_tie"), *names)
    pages = regions.groupBy("page_id").agg(F.sort_array(F.collect_list(row)).alias("_boxes"))

    def step(kept: Column, box: Column) -> Column:
        hit = F.exists(
            kept, lambda k: geometry.iou(geometry.fields(k), geometry.fields(box)) > threshold
        )
        return F.when(hit, kept).otherwise(F.concat(kept, F.array(box)))

    kept = F.aggregate("_boxes", F.slice("_boxes", 1, 0), step)
    return pages.select("page_id", F.inline(kept)).drop("_key", "_tie")


def _suppress_large(regions: DataFrame, threshold: float) -> DataFrame:
    """The same result for pages of any size, box by box.

    A pile of identical boxes is judged by its best one: with IoU 1 to it, and
    the same IoU as it to all others, the rest never survive. Pairs above the
    threshold point from the better to the worse box. A box no pair points to is
    kept and what it points to is gone; repeating that with the pairs that
    remain decides every box.
    """
    solid = regions.filter("x2 > x1 and y2 > y1")
    box = ["x1", "y1", "x2", "y2"]
    best = solid.groupBy("page_id", *box).agg(
        F.min(F.struct((-F.col("confidence")).alias("key"), F.col("ix").alias("ix"))).alias("s")
    )
    candidates = keep(best.select("page_id", *box, "s.key", "s.ix"))
    edges = keep(
        _pairs(candidates, threshold, lambda p, q: F.struct(p["key"], p["ix"]) < F.struct(q["key"], q["ix"])).select(
            "page_id", F.col("a.ix").alias("better"), F.col("b.ix").alias("worse")
        )
    )
    gone = candidates.select("page_id", F.col("ix").alias("worse")).limit(0)
    rounds = 0
    while not edges.isEmpty():
        pointed = edges.select("page_id", F.col("worse").alias("better")).distinct()
        roots = edges.select("page_id", "better").distinct().join(
            pointed, ["page_id", "better"], "left_anti"
        )
        now = edges.join(roots, ["page_id", "better"], "left_semi").select("page_id", "worse").distinct()
        now = keep(now)
        gone = gone.unionByName(now)
        rounds += 1
        if rounds % 16 == 0:
            gone = keep(gone)
        edges = edges.join(now, ["page_id", "worse"], "left_anti").join(
            now.withColumnRenamed("worse", "better"), ["page_id", "better"], "left_anti"
        )
        edges = keep(edges)
    kept = candidates.select("page_id", "ix").join(
        gone.withColumnRenamed("worse", "ix"), ["page_id", "ix"], "left_anti"
    )
    flat = regions.filter("not (x2 > x1 and y2 > y1)")
    return regions.join(kept, ["page_id", "ix"], "left_semi").select(*regions.columns).unionByName(flat)


def suppress(
    regions: DataFrame,
    threshold: float,
    page_boxes: int = PAGE_BOXES,
) -> DataFrame:
    """Regions left after non-maximum suppression on each page.

    Best confidence first (ties by ``ix``), a box goes if its IoU with a kept box
    is above ``threshold``. Pages up to ``page_boxes`` boxes are folded in one
    row; larger ones are worked out across tasks with the same result.
    """
    if not 0 <= threshold < 1:
        raise ValueError("threshold must be in [0, 1)")
    sizes = regions.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))
    large = sizes.filter(F.col("n") > page_boxes).select("page_id")
    if large.isEmpty():
        return _suppress_small(regions, threshold)
    large = keep(large)
    small_pages = regions.join(large, "page_id", "left_anti")
    large_pages = keep(regions.join(large, "page_id", "left_semi"))
    return _suppress_small(small_pages, threshold).unionByName(
        _suppress_large(large_pages, threshold)
    )
