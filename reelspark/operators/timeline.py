"""Edit timelines: transitions, chunked assembly, order across videos, music fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelspark.operators.ordered import COUNT_WIDTH, Run, running
from reelspark.session import durable

#: Transitions that can be asked for or drawn at random.
TRANSITIONS = (
    "fade", "wipeleft", "wiperight", "slideup", "slidedown", "circleopen", "circleclose", "rectcrop", "distance",
    "pixelize", "radial",
)


def _shrunk(prev_ms: Column, next_ms: Column, wanted_ms: int) -> Column:
    """Transition length between two clips; half the shorter one when either is shorter than asked for."""
    shorter = F.least(prev_ms, next_ms)
    return F.when(shorter < wanted_ms, shorter / 2).otherwise(F.lit(float(wanted_ms)))


def _with_previous(clips: DataFrame) -> DataFrame:
    """Add ``prev_ms``, the duration of clip id - 1: every clip also tells its successor, in one aggregation."""
    told = F.array(
        F.struct("id", F.col("duration_ms").alias("own"), F.lit(None).cast("bigint").alias("prev")),
        F.struct((F.col("id") + 1).alias("id"), F.lit(None).cast("bigint").alias("own"), F.col("duration_ms").alias("prev")),
    )
    return (
        clips.select("video_id", F.inline(told))
        .groupBy("video_id", "id")
        .agg(F.max("own").alias("duration_ms"), F.max("prev").alias("prev_ms"))
        .filter("duration_ms IS NOT NULL")
    )


def transitions(clips: DataFrame, wanted_ms: int = 500, *, width: int = COUNT_WIDTH) -> DataFrame:
    """One row per clip of ``clips(video_id, id, duration_ms)`` with the transition leading into it.

    transition_ms and offset_ms are NULL for the first clip; end_ms is the running end of the edit. Videos with
    a non-positive duration cannot be joined and are left out. Lengths are halves of milliseconds at worst, so
    the running sums are exact.
    """
    broken = clips.filter(F.col("duration_ms") <= 0).select("video_id").distinct()
    usable = clips.join(broken, "video_id", "left_anti")
    sized = _with_previous(usable).withColumn(
        "transition_ms",
        F.when(F.col("prev_ms").isNotNull(), _shrunk(F.col("prev_ms"), F.col("duration_ms"), wanted_ms)),
    )
    grown = F.col("duration_ms") - F.coalesce("transition_ms", F.lit(0.0))
    ended = running(sized, ["video_id"], "id", {"edit_end_ms": Run("sum", grown, "through")}, width=width)
    return ended.withColumns(
        {
            "offset_ms": F.when(F.col("transition_ms").isNotNull(), F.col("edit_end_ms") - F.col("duration_ms")),
            "shortened": F.coalesce(F.col("transition_ms") < wanted_ms, F.lit(False)),
        }
    ).drop("prev_ms")


def transition_choice(kind: str, video_id: Column, position: Column) -> Column:
    """Transition name: NULL for none, a reproducible draw for random, fade for unknown kinds."""
    kind = kind.lower()
    if kind == "none":
        return F.lit(None).cast("string")
    if kind == "random":
        digest = F.sha2(F.concat_ws(":", video_id.cast("string"), position.cast("string")), 256)
        pick = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % len(TRANSITIONS)).cast("int")
        return F.get(F.array(*[F.lit(t) for t in TRANSITIONS]), pick)
    return F.lit(kind if kind in TRANSITIONS else "fade")


def chunk_size(value) -> int:
    """Configured chunk size: unparsable -> 4, zero or less -> 0 (off), at least 2 otherwise."""
    try:
        size = int(value)
    except (TypeError, ValueError):
        return 4
    return 0 if size <= 0 else max(size, 2)


def segment_chunks(clips: DataFrame, size: int = 4) -> DataFrame:
    """Chunk of every clip at every level of a tree of joins with at most ``size`` inputs each.

    ``clips(video_id, id)`` with ids 1..n. Level 1 groups clips, level 2 groups those chunks, and so on until one
    chunk holds all; a single clip needs no level. Size 0 turns chunks off: one join holds all clips.
    """
    size = chunk_size(size)
    counts = clips.groupBy("video_id").agg(F.max("id").alias("n"))
    joined = clips.join(counts, "video_id")
    if size == 0:
        return joined.select("video_id", "id", F.lit(1).alias("level"), F.lit(0).cast("bigint").alias("chunk"))
    # Spans of all levels that a BIGINT id can need; one exists while the level below still has more than one part.
    powers = [size**k for k in range(1, 64) if size**k < 2**62]
    spans = F.array(*[F.lit(p).cast("bigint") for p in powers])
    needed = F.filter(spans, lambda p: F.floor(p / size) < F.col("n"))
    return joined.select("video_id", "id", F.posexplode(needed).alias("pos", "span")).select(
        "video_id",
        "id",
        (F.col("pos") + 1).alias("level"),
        F.floor((F.col("id") - 1) / F.col("span")).cast("bigint").alias("chunk"),
    )


def chunk_durations(parts: DataFrame, size: int = 4, wanted_ms: int = 500) -> DataFrame:
    """One level of the tree: parts(video_id, id, duration_ms) -> the same columns for their chunks.

    Inside a chunk neighbours overlap by the transition; the joined length decides the next level's shrinking.
    Windows hold at most ``size`` rows.
    """
    chunked = parts.withColumn("chunk", F.floor((F.col("id") - 1) / size).cast("bigint"))
    window = W.partitionBy("video_id", "chunk").orderBy("id")
    prev = F.lag("duration_ms").over(window)
    overlap = F.coalesce(_shrunk(prev, F.col("duration_ms"), wanted_ms), F.lit(0.0))
    return (
        chunked.withColumn("grown", F.col("duration_ms") - F.when(prev.isNull(), F.lit(0.0)).otherwise(overlap))
        .groupBy("video_id", "chunk")
        .agg(F.sum("grown").alias("duration_ms"))
        .select("video_id", (F.col("chunk") + 1).alias("id"), "duration_ms")
    )


def segment_timeline(clips: DataFrame, size: int = 4, wanted_ms: int = 500) -> DataFrame:
    """Durations of all chunks of every level (level 0 = the clips) up to the one chunk that is the finished edit.

    A video leaves the loop when one part is left, and the loop ends with the longest video: as many rounds as the
    logarithm of its clips. Size 0 turns chunks off: only the clips come back.
    """
    size = chunk_size(size)
    level = clips.select("video_id", F.col("id").cast("bigint").alias("id"), F.col("duration_ms").cast("double").alias("duration_ms"))
    level = durable(level)
    out, number = level.withColumn("level", F.lit(0)), 0
    while size:
        open_ = level.groupBy("video_id").agg(F.max("id").alias("parts")).filter("parts > 1").select("video_id")
        parts = level.join(open_, "video_id", "left_semi")
        if parts.isEmpty():
            break
        number += 1
        level = durable(chunk_durations(parts, size, wanted_ms))
        out = out.unionByName(level.withColumn("level", F.lit(number)))
    return out


def multi_video_order(
    clips: DataFrame, runs: DataFrame, on_failure: str = "skip", *, width: int = COUNT_WIDTH
) -> DataFrame:
    """Position of every clip in the merged edit: input order of the videos, then clip id.

    ``clips(video_id, id, ...)`` with ids 1..n per video, ``runs(batch_id, video_id, input_order, success)``.
    Equal ``input_order`` goes by video_id. ``skip`` leaves failed videos out; ``stop`` gives nothing for a batch in which any video failed. Positions
    are offsets per video plus the id, so no task sees a whole batch of clips.
    """
    if on_failure not in ("skip", "stop"):
        raise ValueError("on_failure must be 'skip' or 'stop'")
    if on_failure == "stop":
        failed = runs.filter(~F.col("success")).select("batch_id").distinct()
        usable = runs.join(failed, "batch_id", "left_anti")
    else:
        usable = runs.filter("success")
    counts = clips.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"))
    per_video = usable.select("batch_id", "video_id", "input_order").join(counts, "video_id")
    offsets = running(
        per_video, ["batch_id"], "input_order", {"offset": Run("sum", F.col("n"))}, width=width, tie=["video_id"]
    )
    return clips.join(offsets.select("batch_id", "video_id", "input_order", "offset"), "video_id").withColumn(
        "position", F.coalesce("offset", F.lit(0)) + F.col("id")
    ).drop("offset")


def music_fit(target_s: Column, music_s: Column) -> Column:
    """struct<loops, trimmed, fade_s, fade_start_s>: how background music covers the edit."""
    fade = F.when(target_s < 2.0, target_s * 0.2).otherwise(F.lit(2.0))
    return F.struct(
        F.greatest(F.lit(1).cast("bigint"), F.ceil(target_s / F.nullif(music_s, F.lit(0.0)))).alias("loops"),
        (music_s > target_s).alias("trimmed"),
        fade.alias("fade_s"),
        (target_s - fade).alias("fade_start_s"),
    )

