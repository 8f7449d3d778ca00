"""From detected regions to page texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.operators import layout
from leafmill.operators.ordering import GROUP_ROWS, has_large_group


def assemble_pages(
    regions: DataFrame,
    confidence: float,
    overlap: float,
    page_boxes: int = layout.PAGE_BOXES,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """``(page_id, part, markdown, confidence)`` of confident, non-overlapping regions."""
    sure = layout.confident(regions, confidence)
    large = has_large_group(sure, ["page_id"], group_rows)
    kept = layout.suppress(sure, overlap, page_boxes)
    scored = F.col("text") != ""
    texts = layout.page_markdown(
        kept,
        large=large,
        sums={"_sum": F.when(scored, F.col("confidence")), "_lines": scored.cast("int")},
    )
    # A page has one part unless it is large, and few parts then.
    page = Window.partitionBy("page_id")
    lines = F.sum("_lines").over(page)
    mean = F.when(lines > 0, F.sum("_sum").over(page) / lines).otherwise(F.lit(0.0))
    return texts.select("page_id", "part", "markdown", mean.alias("confidence"))
