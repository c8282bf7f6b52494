"""Events -> padded intervals -> merged clips -> kill types.

Time is BIGINT milliseconds end to end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelspark.operators.ordered import HOUR_MS, bucket_of, filled

#: Names of multi-kills by kill count.
KILL_NAMES = {1: "single_kill", 2: "double_kill", 3: "triple_kill", 4: "quad_kill", 5: "penta_kill"}
MORE_KILLS = "multi_kill"
SPREAD_KILLS = "multiple_kills"


def to_ms(seconds: float) -> int:
    """Seconds as configured -> whole milliseconds."""
    return round(seconds * 1000)


def pad(events: DataFrame, pre_s: float = 3.0, post_s: float = 1.0) -> DataFrame:
    """Add ``start_ms = max(0, ts - pre)`` and ``end_ms = ts + post`` to every event."""
    return events.withColumns(
        {
            "start_ms": F.greatest(F.lit(0).cast("bigint"), F.col("ts_ms") - to_ms(pre_s)),
            "end_ms": F.col("ts_ms") + to_ms(post_s),
        }
    )


VIDEO = ("video_id",)


def _pieces(segments: DataFrame, width: int, keys=VIDEO) -> DataFrame:
    """Segments cut at time-bucket borders, each with the local clip it falls into.

    Segments are first combined per (video, start) on the map side. A segment reaching over a border leaves a
    piece in every bucket it touches; its kills count in the first one only. Local clips are found per (video,
    bucket), whose rows are bounded by the width.
    """
    instants = segments.groupBy(*keys, "start_ms").agg(
        F.max("end_ms").alias("end_ms"),
        F.count(F.lit(1)).alias("kill_count"),
        F.min("ts_ms").alias("first_ts_ms"),
        F.max("ts_ms").alias("last_ts_ms"),
    )
    first, last = bucket_of(F.col("start_ms"), width), bucket_of(F.col("end_ms"), width)
    cut = instants.withColumn("bucket", F.explode(F.sequence(first, last))).withColumns(
        {
            "continued": F.col("bucket") > first,
            "from_ms": F.greatest(F.col("start_ms"), F.col("bucket") * width),
            "to_ms": F.least(F.col("end_ms"), (F.col("bucket") + 1) * width),
        }
    )
    window = W.partitionBy(*keys, "bucket").orderBy("from_ms", "start_ms")
    reach = F.max("to_ms").over(window.rowsBetween(W.unboundedPreceding, -1))
    opened = cut.withColumn("opened_ms", F.when(reach.isNull() | (F.col("from_ms") > reach), F.col("from_ms")))
    return opened.withColumn(
        "local_ms", F.max("opened_ms").over(window.rowsBetween(W.unboundedPreceding, 0))
    ).drop("opened_ms")


def _chained(local: DataFrame, keys=VIDEO) -> DataFrame:
    """Add ``clip_start_ms`` to local clips (video_id, bucket, local_ms, continued, continues, ...).

    Only the first and last local clip of a bucket can touch a border, so a video's border clips number at most
    two per bucket and are chained by one small window; every other clip is a group of its own.
    """
    edge = F.col("continued") | F.col("continues")
    keyed = local.withColumns({"edge": edge, "inner_ms": F.when(~edge, F.col("local_ms"))})
    window = W.partitionBy(*keys, "edge", "inner_ms").orderBy("bucket", "local_ms")
    start = F.max(F.when(~F.col("continued"), F.col("local_ms"))).over(window.rowsBetween(W.unboundedPreceding, 0))
    return keyed.withColumn("clip_start_ms", start).drop("edge", "inner_ms")


def _local_clips(pieces: DataFrame, width: int, keys=VIDEO) -> DataFrame:
    counted = lambda c: F.when(~F.col("continued"), F.col(c))
    return pieces.groupBy(*keys, "bucket", "local_ms").agg(
        F.max("end_ms").alias("end_ms"),
        F.coalesce(F.sum(counted("kill_count")), F.lit(0)).alias("kill_count"),
        F.min(counted("first_ts_ms")).alias("first_ts_ms"),
        F.max(counted("last_ts_ms")).alias("last_ts_ms"),
        F.bool_or("continued").alias("continued"),
        (F.max("end_ms") >= (F.col("bucket") + 1) * width).alias("continues"),
    )


def merge(segments: DataFrame, *, width: int = HOUR_MS) -> DataFrame:
    """Union of overlapping or touching intervals per video, with kill count and first/last event instant.

    ``segments(video_id, start_ms, end_ms, ts_ms)``; choose ``width`` well above the usual segment length. Every
    step is one pass over ever fewer rows, and members are counted, not collected: one endless clip stays a
    handful of partial aggregates. Use ``members`` for the events of each clip.
    """
    return (
        _chained(_local_clips(_pieces(segments, width), width))
        .groupBy("video_id", F.col("clip_start_ms").alias("start_ms"))
        .agg(
            F.max("end_ms").alias("end_ms"),
            F.sum("kill_count").alias("kill_count"),
            F.min("first_ts_ms").alias("first_ts_ms"),
            F.max("last_ts_ms").alias("last_ts_ms"),
        )
    )


def members(segments: DataFrame, *, width: int = HOUR_MS) -> DataFrame:
    """Every segment with ``clip_start_ms``, the key of the merged clip it went into (long form)."""
    columns = segments.columns
    keyed, keys = filled(segments, VIDEO)
    pieces = _pieces(keyed, width, keys)
    clips = _chained(_local_clips(pieces, width, keys), keys).select(*keys, "bucket", "local_ms", "clip_start_ms")
    starts = pieces.filter(~F.col("continued")).join(clips, [*keys, "bucket", "local_ms"]).select(*keys, "start_ms", "clip_start_ms")
    return keyed.join(starts, [*keys, "start_ms"]).select(*columns, "clip_start_ms")


def merge_sessions(events: DataFrame, pre_s: float = 3.0, post_s: float = 1.0, *, width: int = HOUR_MS) -> DataFrame:
    """``merge(pad(events))`` for constant padding, through native session windows.

    Sessions form per (video, time bucket), so a long recording is many groups; those reaching a border are then
    chained as in ``merge``. An event just before a border also stands in the next bucket as a marker without
    kills, which is how a session knows that it continues.
    """
    gap_ms = to_ms(pre_s) + to_ms(post_s)
    if gap_ms <= 0:
        return merge(pad(events, pre_s, post_s), width=width)
    home = bucket_of(F.col("ts_ms"), width)
    placed = (
        events.groupBy("video_id", "ts_ms")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("bucket", F.explode(F.sequence(home, bucket_of(F.col("ts_ms") + gap_ms, width))))
        .withColumn("marker", F.col("bucket") > home)
        .withColumn("at_ms", F.greatest(F.col("ts_ms"), F.col("bucket") * width))
    )
    # a marker lasts as long as its event still reaches; a session needs a positive gap, so reaching the border
    # exactly is one microsecond, which no later millisecond instant touches
    own = lambda c: F.when(~F.col("marker"), F.col(c))
    left_ms = F.when(F.col("marker"), F.col("ts_ms") + gap_ms - F.col("at_ms")).otherwise(F.lit(gap_ms))
    seconds = F.greatest(left_ms * 1000, F.lit(1)).cast("decimal(18,0)") / F.lit(1_000_000).cast("decimal(18,0)")
    sessions = (
        placed.withColumns(
            {"at": F.timestamp_millis("at_ms"), "span": F.make_interval(secs=seconds.cast("decimal(18,6)"))}
        )
        .groupBy("video_id", "bucket", F.session_window("at", F.col("span")))
        .agg(
            F.min("at_ms").alias("local_ms"),
            F.coalesce(F.sum(own("n")), F.lit(0)).alias("kill_count"),
            F.min(own("ts_ms")).alias("first_ts_ms"),
            F.max(own("ts_ms")).alias("last_ts_ms"),
            F.max("ts_ms").alias("reach_ms"),
            F.bool_or("marker").alias("continued"),
        )
        .drop("session_window")
        .withColumn("continues", F.col("reach_ms") + gap_ms >= (F.col("bucket") + 1) * width)
    )
    return (
        _chained(sessions)
        .groupBy("video_id", "clip_start_ms")
        .agg(
            F.sum("kill_count").alias("kill_count"),
            F.min("first_ts_ms").alias("first_ts_ms"),
            F.max("last_ts_ms").alias("last_ts_ms"),
        )
        .select(
            "video_id",
            F.greatest(F.lit(0).cast("bigint"), F.col("first_ts_ms") - to_ms(pre_s)).alias("start_ms"),
            (F.col("last_ts_ms") + to_ms(post_s)).alias("end_ms"),
            "kill_count",
            "first_ts_ms",
            "last_ts_ms",
        )
    )


def kill_type(kill_count: Column, span_ms: Column, threshold_ms: int | Column) -> Column:
    """Name of a clip by its kills, when they fall within the threshold; ``multiple_kills`` when spread out."""
    named = F.lit(MORE_KILLS)
    for count, name in KILL_NAMES.items():
        if count > 1:
            named = F.when(kill_count == count, F.lit(name)).otherwise(named)
    return (
        F.when(kill_count < 2, F.lit(KILL_NAMES[1]))
        .when(span_ms <= threshold_ms, named)
        .otherwise(F.lit(SPREAD_KILLS))
    )


def classify(clips: DataFrame, multikill_s: float = 10.0) -> DataFrame:
    span = F.col("last_ts_ms") - F.col("first_ts_ms")
    return clips.withColumn("kill_type", kill_type(F.col("kill_count"), span, to_ms(multikill_s)))


def streaks(
    events: DataFrame,
    gap_s: float = 10.0,
    pre_s: float = 3.0,
    post_s: float = 1.0,
    min_kills: int = 1,
    *,
    width: int = HOUR_MS,
) -> DataFrame:
    """Runs of kills each within ``gap_s`` of the one before; one padded clip per run of ``min_kills`` or more."""
    reach = events.withColumns({"start_ms": F.col("ts_ms"), "end_ms": F.col("ts_ms") + to_ms(gap_s)})
    return (
        merge(reach, width=width)
        .filter(F.col("kill_count") >= min_kills)
        .select(
            "video_id",
            F.greatest(F.lit(0).cast("bigint"), F.col("first_ts_ms") - to_ms(pre_s)).alias("start_ms"),
            (F.col("last_ts_ms") + to_ms(post_s)).alias("end_ms"),
            "kill_count",
            "first_ts_ms",
            "last_ts_ms",
        )
    )
