"""Numbering, naming, validating and seek-planning of merged clips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.operators import align
from reelspark.operators.ordered import HOUR_MS, numbered


def number(clips: DataFrame, *, width: int = HOUR_MS) -> DataFrame:
    """1-based ``id`` by start within the video, file name and seconds columns (merged clips never share a start)."""
    named = numbered(clips, ["video_id"], "start_ms", "id", width=width)
    return named.withColumns(
        {
            "filename": F.format_string(
                "clip_%03d_%s_%ds.mp4", "id", "kill_type", F.floor(F.col("start_ms") / 1000)
            ),
            "duration_ms": F.col("end_ms") - F.col("start_ms"),
            "start": F.col("start_ms") / 1000.0,
            "end": F.col("end_ms") / 1000.0,
        }
    )


def clip_path(columns: list[str]) -> Column:
    """``path`` when non-empty, else ``output_path``; NULL when there is neither."""
    found = [F.nullif(F.col(c), F.lit("")) for c in ("path", "output_path") if c in columns]
    return F.coalesce(*found)


def valid_clips(clips: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Clips that name a file and, given ``runs(video_id, success)``, belong to a successful run."""
    named = clips.withColumn("clip_path", clip_path(clips.columns)).filter(F.col("clip_path").isNotNull())
    if runs is None:
        return named
    succeeded = runs.groupBy("video_id").agg(F.bool_and("success").alias("ok")).filter("ok").select("video_id")
    return named.join(succeeded, "video_id", "left_semi")


def cut_plan(
    clips: DataFrame,
    keyframes: DataFrame,
    *,
    stream_copy: bool = False,
    transition: str = "random",
    align_to_keyframes: bool = True,
    window_s: float = 10.0,
    width: int = HOUR_MS,
) -> DataFrame:
    """How to seek for each clip.

    Stream copy is on only without transitions; it moves the start back to the keyframe. Re-encoding keeps the
    start and seeks twice: coarse to the keyframe (or ten seconds ahead), then exact.
    """
    use_copy = stream_copy and transition == "none"
    if align_to_keyframes:
        planned = align.previous_keyframe(clips, keyframes, window_s, width=width)
        duration = F.col("end_ms") - F.col("start_ms")
        key = F.when((F.col("start_ms") > 0) & (duration > 0), F.col("keyframe_ms"))
    else:
        planned, key = clips, F.lit(None).cast("bigint")
    moved = F.lit(use_copy) & F.coalesce(key < F.col("start_ms") - 1, F.lit(False))
    start = F.when(moved, key).otherwise(F.col("start_ms"))
    demux = F.when(key > 0, key).otherwise(F.greatest(F.lit(0).cast("bigint"), start - 10_000))
    planned = planned.withColumns(
        {
            "keyframe_ms": key,
            "copy": F.lit(use_copy),
            "cut_start_ms": start,
            "cut_duration_ms": F.when(moved, F.greatest(F.lit(1).cast("bigint"), F.col("end_ms") - start)).otherwise(
                F.col("end_ms") - F.col("start_ms")
            ),
            "demux_seek_ms": demux,
        }
    )
    return planned.withColumn(
        "precise_seek_ms", F.greatest(F.lit(0).cast("bigint"), F.col("cut_start_ms") - F.col("demux_seek_ms"))
    )
