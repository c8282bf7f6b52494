"""Alignment of instants: as-of, nearest, band and offset joins, and the statistics over aligned pairs.

No join here enumerates the pairs of a group. As-of and nearest interleave both sides on one time axis and carry
the last seen right side forward (``ordered.running``); the band join is a range-frame minimum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelspark.operators.ordered import BUCKET_ROWS, HOUR_MS, Run, numbered, running
from reelspark.session import durable


def _neighbours(left: DataFrame, right: DataFrame, *, width: int) -> DataFrame:
    """(video_id, at_ms) of ``left`` with the closest right instants at or before and at or after it.

    Both sides meet in one aggregation by instant; ``sides`` says which of them is there (1 left, 2 right, 3 both).
    """
    side = lambda df, n: df.select("video_id", "at_ms", F.lit(n).alias("side"))
    axis = (
        side(left, 1).unionByName(side(right, 2)).groupBy("video_id", "at_ms").agg(F.bit_or("side").alias("sides"))
    )
    point = F.when(F.col("sides") >= 2, F.col("at_ms"))
    runs = {"before_ms": Run("max", point, "through"), "after_ms": Run("min", point, "onward")}
    found = running(axis, ["video_id"], "at_ms", runs, width=width)
    return found.filter(F.col("sides") != 2).drop("sides")


def previous_keyframe(
    starts: DataFrame, keyframes: DataFrame, window_s: float = 10.0, eps_s: float = 0.10, *, width: int = HOUR_MS
) -> DataFrame:
    """Latest keyframe no later than start + eps and no earlier than start - max(0.5 s, window).

    ``starts(video_id, start_ms, ...)`` gains ``keyframe_ms``: 0 for starts at or before zero, NULL for none.
    ``keyframes(video_id, keyframe_ms)``.
    """
    eps, reach = round(eps_s * 1000), round(max(0.5, window_s) * 1000)
    asked = starts.filter(F.col("start_ms") > 0).select("video_id", (F.col("start_ms") + eps).alias("at_ms"))
    points = keyframes.select("video_id", F.col("keyframe_ms").alias("at_ms"))
    found = _neighbours(asked, points, width=width).select(
        "video_id", (F.col("at_ms") - eps).alias("start_ms"), F.col("before_ms").alias("__kf")
    )
    earliest = F.greatest(F.lit(0).cast("bigint"), F.col("start_ms") - reach)
    return (
        starts.join(found, ["video_id", "start_ms"], "left")
        .withColumn(
            "keyframe_ms",
            F.when(F.col("start_ms") <= 0, F.lit(0).cast("bigint")).when(F.col("__kf") >= earliest, F.col("__kf")),
        )
        .drop("__kf")
    )


def nearest(left: DataFrame, right: DataFrame, tol_ms: int, *, width: int = HOUR_MS) -> DataFrame:
    """Each distinct left instant with the closest right instant within ``tol_ms``; ties go to the earlier one.

    Inputs are (video_id, ts_ms); output (video_id, ts_ms, match_ms, gap_ms). Left instants without a partner
    are dropped.
    """
    at = lambda df: df.select("video_id", F.col("ts_ms").alias("at_ms"))
    both = _neighbours(at(left), at(right), width=width)
    back, ahead = F.col("at_ms") - F.col("before_ms"), F.col("after_ms") - F.col("at_ms")
    take_back = back.isNotNull() & (ahead.isNull() | (back <= ahead))
    match = F.when(take_back, F.col("before_ms")).otherwise(F.col("after_ms"))
    return (
        both.select("video_id", F.col("at_ms").alias("ts_ms"), match.alias("match_ms"))
        .withColumn("gap_ms", F.abs(F.col("match_ms") - F.col("ts_ms")))
        .filter(F.col("gap_ms") <= tol_ms)
    )


def within(frames: DataFrame, events: DataFrame, half_width_ms: int, *, width: int = HOUR_MS) -> DataFrame:
    """Annotate frames with the first event (lowest ``event_seq``) at a distance below ``half_width_ms``.

    ``frames(video_id, ts_ms)``, ``events(video_id, ts_ms, event_seq)``. Later events at an instant replace
    earlier ones but keep their place, so an instant counts by its first sequence number. Both sides are reduced
    to distinct instants; each time bucket also sees the events just over its edges; a RANGE frame takes the
    minimum.
    """
    span = half_width_ms - 1
    width = max(width, 2 * half_width_ms)
    instants = events.groupBy("video_id", "ts_ms").agg(F.min("event_seq").alias("seq"))
    placed = instants.withColumn(
        "bucket",
        F.explode(
            F.sequence(
                F.floor((F.col("ts_ms") - span) / width).cast("bigint"),
                F.floor((F.col("ts_ms") + span) / width).cast("bigint"),
            )
        ),
    ).select(
        "video_id",
        "bucket",
        "ts_ms",
        F.struct(F.col("seq").alias("event_seq"), F.col("ts_ms").alias("event_ts_ms")).alias("hit"),
        F.lit(False).alias("is_frame"),
    )
    marks = (
        frames.select("video_id", "ts_ms")
        .distinct()
        .select(
            "video_id",
            F.floor(F.col("ts_ms") / width).cast("bigint").alias("bucket"),
            "ts_ms",
            F.lit(None).cast("struct<event_seq:bigint,event_ts_ms:bigint>").alias("hit"),
            F.lit(True).alias("is_frame"),
        )
    )
    window = W.partitionBy("video_id", "bucket").orderBy("ts_ms").rangeBetween(-span, span)
    found = (
        marks.unionByName(placed)
        .withColumn("best", F.min("hit").over(window))
        .filter("is_frame")
        .select("video_id", "ts_ms", "best.event_seq", "best.event_ts_ms")
    )
    return frames.join(found, ["video_id", "ts_ms"], "left")


def event_frames(events: DataFrame, frames: DataFrame) -> DataFrame:
    """Evidence frame of every event at its exact instant; the first file (lowest ``frame_seq``) wins."""
    first = frames.groupBy("video_id", "ts_ms").agg(F.min_by("frame_path", "frame_seq").alias("frame_path"))
    return events.drop("frame_path").join(first, ["video_id", "ts_ms"], "left")


def offset_probe(
    pairs: DataFrame, similarities: DataFrame, offsets_ms=(-2000, -1000, 1000, 2000), below: float = 95.0
) -> DataFrame:
    """For pairs less similar than ``below``, the shifted instant with the strictly best higher similarity.

    Both inputs are (video_id, ts_ms, similarity). Output adds best_offset_ms (0: none better) and
    best_similarity.
    """
    known = similarities.groupBy("video_id", F.col("ts_ms").alias("probe_ms")).agg(
        F.max("similarity").alias("probe_similarity")
    )
    order = F.array(*[F.lit(o).cast("bigint") for o in offsets_ms])
    tried = (
        pairs.filter(F.col("similarity") < below)
        .select("video_id", "ts_ms", "similarity", F.posexplode(order).alias("pos", "offset"))
        .withColumn("probe_ms", F.col("ts_ms") + F.col("offset"))
        .join(known, ["video_id", "probe_ms"])
        .filter(F.col("probe_similarity") > F.col("similarity"))
        .groupBy("video_id", "ts_ms")
        .agg(F.max(F.struct("probe_similarity", (-F.col("pos")).alias("rank"), "offset")).alias("best"))
    )
    return pairs.join(tried, ["video_id", "ts_ms"], "left").select(
        *pairs.columns,
        F.coalesce("best.offset", F.lit(0).cast("bigint")).alias("best_offset_ms"),
        F.coalesce("best.probe_similarity", "similarity").alias("best_similarity"),
    )


def mean_abs_diff(a: Column, b: Column) -> Column:
    """Mean absolute difference of two equal-length numeric arrays."""
    gaps = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    return F.aggregate(gaps, F.lit(0.0), lambda s, v: s + v) / F.size(a)


def mean_sq_diff(a: Column, b: Column) -> Column:
    gaps = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))
    return F.aggregate(gaps, F.lit(0.0), lambda s, v: s + v) / F.size(a)


def frame_diff(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Add mae, mse and similarity (percent, from 8-bit grey levels) of two pixel vectors."""
    mae = mean_abs_diff(F.col(a), F.col(b))
    return pairs.withColumns({"mae": mae, "mse": mean_sq_diff(F.col(a), F.col(b)), "similarity": 100 - mae / 255 * 100})


#: Bins of an octave in ``magnitude_bin``.
OCTAVE_BINS = 256


def magnitude_bin(v: Column) -> Column:
    """An integer that never falls as ``v`` grows: sign, binary exponent and the next eight bits of a double, then infinity and NaN."""
    size = F.abs(v)
    exponent = F.floor(F.log2(size))
    within = F.floor((size / F.pow(F.lit(2.0), exponent) - 1) * OCTAVE_BINS)
    # 1100 octaves up, so that the bins of one sign are all on one side of zero
    place = F.when(size == float("inf"), F.lit(1 << 20)).otherwise((exponent + 1100) * OCTAVE_BINS + within)
    return F.when(F.isnan(v), F.lit(1 << 21)).when(v == 0, F.lit(0)).otherwise(F.signum(v) * place).cast("bigint")


def diff_stats(pairs: DataFrame, column: str = "mae", q: float = 0.95) -> DataFrame:
    """One row: n, mean, exact linearly interpolated quantile, max of ``column``.

    The quantile never gathers the values. They are stored once; a histogram by magnitude, which no outlier can coarsen,
    finds the at most two bins holding the order statistics; the distinct values of those are counted, and summed up in
    value order in buckets of rows.
    """
    values = durable(pairs.filter(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v")))
    ends = values.agg(F.max("v").alias("hi"), F.count("v").alias("n"), F.avg("v").alias("mean"))
    binned = values.withColumn("bin", magnitude_bin(F.col("v")))
    counts = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("c")).withColumn("g", F.lit(0))
    pos = (F.col("n") - 1) * q
    lo_rank, hi_rank = F.floor(pos), F.ceil(pos)
    holds = lambda rank: (F.col("from") <= rank) & (rank < F.col("from") + F.col("c"))
    below = running(counts, ["g"], "bin", {"below": Run("sum", F.col("c"))}, width=4096)
    placed = below.withColumns({"from": F.coalesce("below", F.lit(0)), "n": ends.select("n").scalar()})
    targets = placed.filter(holds(lo_rank) | holds(hi_rank)).select("bin", "from", "n")
    distinct = binned.join(F.broadcast(targets), "bin").groupBy("bin", "from", "n", "v").agg(F.count(F.lit(1)).alias("c"))  # at most two bins
    ranked = running(distinct, ["bin"], "v", {"inside": Run("sum", F.col("c"))}, rows=BUCKET_ROWS)
    ranked = ranked.withColumn("from", F.col("from") + F.coalesce("inside", F.lit(0)))
    at = lambda rank: F.max(F.when(holds(rank), F.col("v")))
    quantile = ranked.agg(at(lo_rank).alias("a"), at(hi_rank).alias("b"), F.max(pos - F.floor(pos)).alias("f")).select(
        F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("f")).alias("q")
    )
    return ends.select("n", "mean", quantile.scalar().alias("quantile"), F.col("hi").alias("max"))


def worst_pairs(pairs: DataFrame, k: int = 6, column: str = "mae", tie=("video_id", "ts_ms")) -> DataFrame:
    """The k pairs with the largest difference."""
    return pairs.orderBy(F.col(column).desc(), *tie).limit(k)


def timing_verdict(similarity: Column) -> Column:
    """match above 95 %, warning above 85 %, mismatch otherwise or when missing."""
    return F.when(similarity > 95, "match").when(similarity > 85, "warning").otherwise("mismatch")


def timing_counts(pairs: DataFrame) -> DataFrame:
    verdict = timing_verdict(F.col("similarity"))
    return pairs.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(verdict == v).alias(f"n_{v}") for v in ("match", "warning", "mismatch")],
    )


def frame_names(frames: DataFrame, *, width: int = 100_000) -> DataFrame:
    """``frame_<ts>.jpg``; further frames at the same instant get ``_1``, ``_2`` ... in order of ``n``."""
    ranked = numbered(frames, ["video_id", "ts_ms"], "n", "__k", width=width)
    k = F.col("__k") - 1
    return ranked.withColumn(
        "frame_name",
        F.when(k == 0, F.format_string("frame_%d.jpg", "ts_ms")).otherwise(F.format_string("frame_%d_%d.jpg", "ts_ms", k)),
    ).drop("__k")
