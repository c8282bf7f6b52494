"""HSV arithmetic on the 8-bit scale (hue 0-179, saturation and value 0-255)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Highest hue, saturation and value on the 8-bit scale.
HSV_MAX = (179, 255, 255)


def _around(hsv: Column, tolerance: Column) -> Column:
    tops = F.array(*[F.lit(v).cast("double") for v in HSV_MAX])
    zero = F.lit(0.0)
    lower = F.zip_with(hsv, tolerance, lambda c, t: F.greatest(zero, c - t))
    upper = F.zip_with(F.zip_with(hsv, tolerance, lambda c, t: c + t), tops, lambda v, top: F.least(top, v))
    return F.struct(lower.alias("lower"), upper.alias("upper"))


def hsv_bounds(lower: Column, upper: Column, center: Column, tolerance: Column) -> Column:
    """struct<lower,upper> of array<double>.

    Explicit non-empty bounds are final. Otherwise the centre plus/minus the tolerance, where a one-element
    tolerance t stands for (t, 2t, 2t). Anything else -> NULL.
    """
    has_bounds = F.coalesce((F.size(lower) > 0) & (F.size(upper) > 0), F.lit(False))
    tol = F.coalesce(tolerance, F.array(F.lit(0.0)))
    tol = F.when(F.size(tol) == 1, F.array(tol[0], tol[0] * 2, tol[0] * 2)).when(F.size(tol) == 3, tol)
    derived = F.when((F.size(center) > 0) & tol.isNotNull(), _around(center, tol))
    return F.when(has_bounds, F.struct(lower.alias("lower"), upper.alias("upper"))).otherwise(derived)


def hsv_range(h: Column, s: Column, v: Column, tolerance=(10, 50, 50)) -> Column:
    """struct<lower,upper> of array<int>: centre plus/minus the triple, clamped to the scale."""
    channels = list(zip((h, s, v), tolerance, HSV_MAX))
    return F.struct(
        F.array(*[F.greatest(F.lit(0), c - t) for c, t, _ in channels]).alias("lower"),
        F.array(*[F.least(F.lit(top), c + t) for c, t, top in channels]).alias("upper"),
    )


def rgb_to_hsv(r: Column, g: Column, b: Column) -> Column:
    """struct<h,s,v> of int from 8-bit RGB; hue is halved degrees."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    spread = F.nullif((top - low).cast("double"), F.lit(0.0))
    sector = (
        F.when(top == r, (g - b) / spread).when(top == g, F.lit(2.0) + (b - r) / spread).otherwise(4 + (r - g) / spread)
    )
    half_degrees = F.coalesce(sector * 30, F.lit(0.0))
    hue = F.floor(F.when(half_degrees < 0, half_degrees + 180).otherwise(half_degrees) + 0.5) % 180
    sat = F.coalesce(F.floor((top - low) * 255.0 / F.nullif(top.cast("double"), F.lit(0.0)) + 0.5), F.lit(0))
    return F.struct(hue.cast("int").alias("h"), sat.cast("int").alias("s"), top.cast("int").alias("v"))
