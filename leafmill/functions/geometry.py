"""Box expressions: overlap, rescale, resize plans, tiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Detector input side, recognition height, confidence threshold.
DETECTOR_SIDE = 1024
LINE_HEIGHT = 32
CONFIDENCE = 0.5


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union of boxes given by x1, y1, x2, y2; 0 without overlap."""
    width = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    height = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    shared = width * height
    area_a = (a["x2"] - a["x1"]) * (a["y2"] - a["y1"])
    area_b = (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])
    union = area_a + area_b - shared
    return F.when((width > 0) & (height > 0) & (union > 0), shared / union).otherwise(F.lit(0.0))


def fields(box: Column) -> dict[str, Column]:
    return {n: box[n] for n in ("x1", "y1", "x2", "y2")}


def columns(prefix: str = "") -> dict[str, Column]:
    return {n: F.col(prefix + n) for n in ("x1", "y1", "x2", "y2")}


def resized(side: Column, width: Column, height: Column, limit: int = DETECTOR_SIDE) -> Column:
    """A side after shrinking the longer side to ``limit``; unchanged if it fits.

    Single precision, as in every pixel computation here.
    """
    longer = F.greatest(width, height)
    scale = (F.lit(limit) / longer).cast("float")
    return F.when(longer > limit, (side.cast("float") * scale).cast("int")).otherwise(
        side.cast("int")
    )


def rescaled(box: dict[str, Column], width: Column, height: Column) -> dict[str, Column]:
    """Detector box to whole image pixels, clamped to the image."""

    def at_least_zero(value: Column, side: Column) -> Column:
        scaled = value.cast("float") * (side / F.lit(DETECTOR_SIDE)).cast("float")
        return F.greatest(scaled, F.lit(0.0).cast("float")).cast("int")

    def inside(value: Column, side: Column) -> Column:
        scaled = value.cast("float") * (side / F.lit(DETECTOR_SIDE)).cast("float")
        return F.least(scaled, side.cast("float") - F.lit(1.0).cast("float")).cast("int")

    return {
        "x1": at_least_zero(box["x1"], width),
        "y1": at_least_zero(box["y1"], height),
        "x2": inside(box["x2"], width),
        "y2": inside(box["y2"], height),
    }


def line_width(width: Column, height: Column) -> Column:
    """Recognition width of a crop scaled to the line height, at least 1."""
    aspect = (width / height).cast("float")
    return F.greatest((F.lit(float(LINE_HEIGHT)).cast("float") * aspect).cast("int"), F.lit(1))
