"""Pixel measurements: colour coverage and template correlation."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.functions import color

#: Templates carried to every task at most; larger sets are matched block by block.
TEMPLATE_BLOCK = 256


def coverage_from_pixels(pixels: DataFrame, bounds: Mapping[str, tuple[list, list]], keys=("image_id",)) -> DataFrame:
    """Share of pixels inside each colour's inclusive HSV bounds, from ``pixels(keys, r, g, b)``.

    All colours in one pass; partial counts combine on the map side.
    """
    hsv = pixels.select(*keys, color.rgb_to_hsv(F.col("r"), F.col("g"), F.col("b")).alias("p"))

    def inside(low: list, high: list) -> Column:
        return (
            F.col("p.h").between(low[0], high[0])
            & F.col("p.s").between(low[1], high[1])
            & F.col("p.v").between(low[2], high[2])
        )

    counted = hsv.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(inside(*b)).alias(f"__{name}") for name, b in bounds.items()]
    )
    rows = F.array(
        *[F.struct(F.lit(n).alias("color"), (F.col(f"__{n}") / F.col("n")).alias("pct")) for n in bounds]
    )
    return counted.select(*keys, F.inline(rows))


def _hsv(bgr: np.ndarray) -> np.ndarray:
    """8-bit HSV of an (n, 3) BGR array, as ``functions.color.rgb_to_hsv``."""
    b, g, r = (bgr[:, i].astype(np.int64) for i in range(3))
    top, low = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    spread = top - low
    safe = np.where(spread == 0, 1, spread)
    sector = np.where(top == r, (g - b) / safe, np.where(top == g, 2 + (b - r) / safe, 4 + (r - g) / safe))
    half = np.where(spread == 0, 0.0, sector * 30)
    hue = np.floor(np.where(half < 0, half + 180, half) + 0.5).astype(np.int64) % 180
    sat = np.where(top == 0, 0, np.floor(spread * 255.0 / np.where(top == 0, 1, top) + 0.5)).astype(np.int64)
    return np.stack([hue, sat, top], axis=1)


def color_coverage(images: DataFrame, bounds: Mapping[str, tuple[list, list]], roi: list[float] | None = None) -> DataFrame:
    """The same from packed images ``images(image_id, width, height, bgr BINARY)``, over a ROI in fractions.

    An empty ROI covers 0. Each image is one Arrow row; images spread over tasks.
    """
    x, y, w, h = roi or [0.0, 0.0, 1.0, 1.0]
    limits = {n: (np.asarray(lo), np.asarray(hi)) for n, (lo, hi) in bounds.items()}
    schema = f"image_id {images.schema['image_id'].dataType.simpleString()}, color string, pct double"

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for image_id, width, height, data in batch.itertuples(index=False):
                frame = np.frombuffer(data, dtype=np.uint8).reshape(height, width, 3)
                left, top = int(x * width), int(y * height)
                area = frame[top : top + int(h * height), left : left + int(w * width)].reshape(-1, 3)
                hsv = _hsv(area) if len(area) else None
                for name, (lo, hi) in limits.items():
                    share = float(((hsv >= lo) & (hsv <= hi)).all(axis=1).mean()) if hsv is not None else 0.0
                    rows.append((image_id, name, share))
            yield pd.DataFrame(rows, columns=["image_id", "color", "pct"])

    return images.select("image_id", "width", "height", "bgr").mapInPandas(measure, schema)


def weakest_color(colors: DataFrame) -> DataFrame:
    """Colour with the lowest coverage per frame, flagged when below one percent (name breaks ties)."""
    return (
        colors.groupBy("video_id", "ts_ms")
        .agg(F.min(F.struct("pct", "color")).alias("m"))
        .select("video_id", "ts_ms", F.col("m.color").alias("color"), F.col("m.pct").alias("pct"), (F.col("m.pct") < 0.01).alias("weak"))
    )


def normalised(df: DataFrame, column: str, out: str) -> DataFrame:
    """Add the zero-mean unit-length form of a numeric array column (flat vectors become zeros)."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    doubles = df.withColumn("__d", F.transform(column, lambda x: x.cast("double")))
    means = doubles.withColumn("__mean", total(F.col("__d")) / F.size("__d"))
    centred = means.withColumn("__c", F.transform("__d", lambda x: x - F.col("__mean")))
    norms = centred.withColumn("__norm", F.sqrt(total(F.transform("__c", lambda x: x * x))))
    return norms.withColumn(
        out, F.transform("__c", lambda x: F.coalesce(F.try_divide(x, F.col("__norm")), F.lit(0.0)))
    ).drop("__d", "__mean", "__c", "__norm")


def _best(vec: Column, templates: Column) -> Column:
    """Best template for a normalised vector: struct<score, template>; larger templates are skipped."""
    fits = F.filter(templates, lambda t: F.size(t["vec"]) == F.size(vec))
    dot = lambda t: F.aggregate(F.zip_with(vec, t["vec"], lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return F.array_max(F.transform(fits, lambda t: F.struct(dot(t).alias("score"), t["name"].alias("template"))))


def template_correlation(
    patches: DataFrame, templates: DataFrame, keys=("patch_id",), block: int = TEMPLATE_BLOCK
) -> DataFrame:
    """Best normalised correlation per patch over equal-length vectors: (keys, template, score), -1 if none fits.

    ``patches(keys, vec)``, ``templates(name, vec)``. The template set is counted first (at most ``block`` + 1
    rows are read). Up to ``block`` templates travel as one scalar subquery. Larger sets are hashed into blocks
    of about half that; patches meet each block through an equi-join and keep one row per block.
    """
    keys = list(keys)
    units = normalised(templates, "vec", "unit").select("name", F.col("unit").alias("vec"))
    ready = normalised(patches, "vec", "unit").select(*keys, "unit")
    gathered = F.collect_list(F.struct("name", "vec"))
    if templates.limit(block + 1).count() <= block:
        found = ready.withColumn("ts", units.agg(gathered.alias("ts")).scalar())
        found = found.select(*keys, _best(F.col("unit"), F.col("ts")).alias("best"))
    else:
        n_blocks = max(1, -(-templates.count() * 2 // block))
        blocks = units.groupBy(F.pmod(F.xxhash64("name"), F.lit(n_blocks)).cast("int").alias("blk")).agg(gathered.alias("ts"))
        spread = ready.withColumn("blk", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
        found = (
            spread.join(blocks, "blk")
            .select(*keys, _best(F.col("unit"), F.col("ts")).alias("best"))
            .groupBy(*keys)
            .agg(F.max("best").alias("best"))
        )
    return found.select(
        *keys, F.col("best.template").alias("template"), F.coalesce("best.score", F.lit(-1.0)).alias("score")
    )


def slide_templates(images: DataFrame, templates: Mapping[str, np.ndarray]) -> DataFrame:
    """Best position of each grey template inside packed grey images ``images(image_id, width, height, grey)``.

    Output (image_id, template, score, x, y); a template larger than the image scores -1 without a position.
    """
    # the id goes through pandas as text: beside a null, whole numbers would become doubles there
    schema = "image_id string, template string, score double, x int, y int"
    kind = images.schema["image_id"].dataType
    prepared = {}
    for name, pixels in templates.items():
        centred = pixels.astype(np.float64) - pixels.mean()
        prepared[name] = (centred, float(np.sqrt((centred**2).sum())))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for image_id, width, height, data in batch.itertuples(index=False):
                frame = np.frombuffer(data, dtype=np.uint8).reshape(height, width).astype(np.float64)
                for name, (centred, norm) in prepared.items():
                    if centred.shape[0] > height or centred.shape[1] > width:
                        rows.append((image_id, name, -1.0, None, None))
                        continue
                    views = np.lib.stride_tricks.sliding_window_view(frame, centred.shape)
                    dots = np.einsum("ijkl,kl->ij", views, centred)
                    spread = np.sqrt(np.maximum((views**2).sum((2, 3)) - views.sum((2, 3)) ** 2 / centred.size, 0.0))
                    scores = np.divide(dots, spread * norm, out=np.zeros_like(dots), where=spread * norm > 1e-12)
                    y, x = np.unravel_index(int(scores.argmax()), scores.shape)
                    rows.append((image_id, name, float(scores[y, x]), int(x), int(y)))
            out = pd.DataFrame(rows, columns=["image_id", "template", "score", "x", "y"])
            yield out.astype({"x": "Int32", "y": "Int32"})

    found = images.select(F.col("image_id").cast("string").alias("image_id"), "width", "height", "grey").mapInPandas(search, schema)
    return found.withColumn("image_id", F.col("image_id").cast(kind))
