"""Regions of interest. A ROI is an array [x, y, w, h]; fractions of the image unless named pixels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _full() -> Column:
    return F.array(*[F.lit(v) for v in (0.0, 0.0, 1.0, 1.0)])


def _numbers(roi: Column) -> Column:
    return F.transform(roi, lambda v: v.try_cast("double"))


def _four_numbers(roi: Column) -> Column:
    return F.coalesce((F.size(roi) == 4) & F.forall(roi, lambda v: v.try_cast("double").isNotNull()), F.lit(False))


def normalize(roi: Column) -> Column:
    """Four numbers as they are, anything else the full frame. No clamping."""
    return F.when(_four_numbers(roi), _numbers(roi)).otherwise(_full())


def normalize_clamped(roi: Column) -> Column:
    """Clamp the corner into the image and the size to what remains; empty -> full frame."""
    n = normalize(roi)
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), n[0]))
    y = F.greatest(F.lit(0.0), F.least(F.lit(1.0), n[1]))
    w = F.greatest(F.lit(0.0), F.least(F.lit(1.0) - x, n[2]))
    h = F.greatest(F.lit(0.0), F.least(F.lit(1.0) - y, n[3]))
    return F.when((w > 0) & (h > 0), F.array(x, y, w, h)).otherwise(_full())


def to_pixels(roi: Column, width: Column, height: Column) -> Column:
    """Fractions -> pixels, each product truncated."""
    return F.array(*[(roi[i] * (width if i % 2 == 0 else height)).cast("int") for i in range(4)])


def clip_pixels(roi: Column, width: Column, height: Column) -> Column:
    """Intersect a pixel ROI with the image -> [x1, y1, x2, y2], NULL when nothing is left."""
    x1, y1 = F.greatest(F.lit(0), roi[0]), F.greatest(F.lit(0), roi[1])
    x2, y2 = F.least(width, roi[0] + roi[2]), F.least(height, roi[1] + roi[3])
    return F.when((x2 > x1) & (y2 > y1), F.array(x1, y1, x2, y2))


def shift_bbox(bbox: Column, dx: Column, dy: Column) -> Column:
    """Translate a polygon [[x, y], ...] into frame coordinates."""
    return F.transform(bbox, lambda p: F.array(p[0] + dx, p[1] + dy))


def relative_box(bbox: Column, roi: Column, width: Column, height: Column) -> Column:
    """Polygon -> its bounding box clamped to the ROI, as ROI fractions; NULL when not a quad or ROI empty."""
    def coordinates(axis: int) -> Column:
        return F.transform(bbox, lambda p: p[axis].cast("double"))

    out = []
    for axis, extent in ((0, width), (1, height)):
        lo, span = roi[axis] * extent, roi[axis + 2] * extent
        coords = coordinates(axis)
        near = F.greatest(lo, F.least(lo + span, F.array_min(coords)))
        far = F.greatest(lo, F.least(lo + span, F.array_max(coords)))
        out.append(((near - lo) / F.nullif(span, F.lit(0.0)), (far - near) / F.nullif(span, F.lit(0.0)), span > 0))
    (x, w, okx), (y, h, oky) = out
    return F.when((F.size(bbox) >= 4) & okx & oky, F.array(x, y, w, h))
