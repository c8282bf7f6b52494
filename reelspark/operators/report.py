"""Per-video reports as ordered lines; ``sources.sinks`` writes them out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.functions import fmt, parse


def stats(clips: DataFrame) -> DataFrame:
    """Clips and kills per video and kill type (missing type -> unknown)."""
    kind = F.coalesce("kill_type", F.lit("unknown"))
    return clips.groupBy("video_id", kind.alias("kill_type")).agg(
        F.count(F.lit(1)).alias("clips"), F.coalesce(F.sum("kill_count"), F.lit(0)).alias("kills")
    )


def video_stats(info: DataFrame) -> DataFrame:
    """Path, size, fps and duration text of each video from either naming scheme; missing values get defaults.

    ``info(video_id, video_path, path, width, height, resolution, fps, duration_str, duration)``.
    """
    size = parse.resolution(F.col("resolution"))
    filled = lambda c: F.nullif(F.col(c), F.lit(0))
    either = lambda c: F.nullif(F.col(c), F.lit(""))
    return info.select(
        "video_id",
        F.coalesce(either("video_path"), F.col("path"), F.lit("Unknown")).alias("video_path"),
        F.coalesce(filled("width"), size["width"], F.lit(0)).alias("width"),
        F.coalesce(filled("height"), size["height"], F.lit(0)).alias("height"),
        F.coalesce("fps", F.lit(0.0)).alias("fps"),
        F.coalesce(either("duration_str"), fmt.duration(F.col("duration"))).alias("duration_str"),
    )


def _lines(section: int, texts: list[Column]) -> Column:
    return F.transform(
        F.array(*texts),
        lambda t, i: F.struct(F.lit(section).alias("section"), i.cast("bigint").alias("pos"), t.alias("line")),
    )


def lines(
    videos: DataFrame,
    clips: DataFrame,
    title: str = "Highlight Processing Report",
    config: DataFrame | None = None,
    logs: DataFrame | None = None,
    generated_on: Column | None = None,
) -> DataFrame:
    """(video_id, section, pos, line): the Markdown report of every video, one row per line.

    ``videos`` as from ``video_stats``, ``clips`` numbered per video, ``config(video_id, line_no, text)`` and
    ``logs(video_id, line_no, text)`` optional; a video without logs has no section for them. ``generated_on`` is a timestamp.
    The document is the lines in (section, pos) order. No video's clip table is gathered anywhere.
    """
    totals = clips.groupBy("video_id").agg(
        F.coalesce(F.sum("kill_count"), F.lit(0)).alias("kills"), F.count(F.lit(1)).alias("clips")
    )
    base = videos.join(totals, "video_id", "left").fillna(0, ["kills", "clips"])
    # Fixed values, here and below: headings and labels that readers of reports look for.
    head = _lines(
        0,
        [
            F.lit(f"# {title}"),
            *([] if generated_on is None else [F.concat(F.lit("Generated on: "), F.date_format(generated_on, "yyyy-MM-dd HH:mm:ss"))]),
            F.lit(""),
            F.lit("## 1. Video Statistics"),
            F.format_string("- **Source File**: %s", "video_path"),
            F.format_string("- **Resolution**: %dx%d", "width", "height"),
            F.concat(F.lit("- **FPS**: "), F.col("fps").cast("string")),
            F.format_string("- **Duration**: %s", "duration_str"),
            F.lit(""),
            F.lit("## 2. Detection Summary"),
            F.format_string("- **Total Kills Detected**: %d", "kills"),
            F.format_string("- **Total Clips Extracted**: %d", "clips"),
            F.lit(""),
        ],
    )
    table_head = F.when(
        F.col("clips") > 0,
        _lines(
            2,
            [
                F.lit("## 3. Detailed Clips List"),
                F.lit("| Clip # | Start Time | End Time | Kill Count | Type |"),
                F.lit("|---|---|---|---|---|"),
            ],
        ),
    ).otherwise(_lines(2, [F.lit("## 3. Detailed Clips List"), F.lit("No kills detected in this run.")]))
    gap = F.when(F.col("clips") > 0, _lines(1, [F.lit("### Breakdown by Kill Type")])).otherwise(
        F.array().cast("array<struct<section:int,pos:bigint,line:string>>")
    )
    fixed = base.select("video_id", F.inline(F.concat(head, gap, table_head, _lines(4, [F.lit("")]))))
    types = stats(clips)
    by_type = types.select(
        "video_id",
        F.lit(1).alias("section"),
        F.concat(F.lit("- "), fmt.title(F.col("kill_type")), F.lit(": "), F.col("clips").cast("string")).alias("line"),
        "kill_type",
    )
    # kill types are a handful of names, so a video's sorted set of them is small
    ranks = types.groupBy("video_id").agg(F.array_sort(F.collect_set("kill_type")).alias("order"))
    by_type = by_type.join(ranks, "video_id").select(
        "video_id", "section", F.array_position("order", F.col("kill_type")).cast("bigint").alias("pos"), "line"
    )
    after_types = ranks.select(
        "video_id", F.lit(1).alias("section"), (F.size("order") + 1).cast("bigint").alias("pos"), F.lit("").alias("line")
    )
    kind = fmt.title(F.coalesce("kill_type", F.lit("single_kill")))
    table = clips.select(
        "video_id",
        F.lit(3).alias("section"),
        F.col("id").cast("bigint").alias("pos"),
        F.format_string(
            "| %d | %s | %s | %d | %s |",
            F.col("id").cast("bigint"),
            fmt.ms(F.coalesce("start_ms", F.lit(0))),
            fmt.ms(F.coalesce("end_ms", F.lit(0))),
            F.coalesce("kill_count", F.lit(0)).cast("bigint"),
            kind,
        ).alias("line"),
    )
    out = fixed.unionByName(by_type).unionByName(after_types).unionByName(table)
    if config is not None:
        out = out.unionByName(_quoted(videos, config, 5, "## 4. Configuration Summary", "yaml"))
    if logs is not None:
        logged = videos.join(logs.select("video_id").distinct(), "video_id", "left_semi")
        out = out.unionByName(_quoted(logged, logs, 8, "## 5. Processing Logs", ""))
    return out


def _quoted(videos: DataFrame, texts: DataFrame, section: int, heading: str, language: str) -> DataFrame:
    """A section of quoted lines; it may be long, so its lines stay rows of their own."""
    head = videos.select("video_id", F.inline(_lines(section, [F.lit(heading), F.lit(f"```{language}")])))
    body = texts.select("video_id", F.lit(section + 1).alias("section"), F.col("line_no").cast("bigint").alias("pos"), F.col("text").alias("line"))
    return head.unionByName(body).unionByName(videos.select("video_id", F.inline(_lines(section + 2, [F.lit("```"), F.lit("")]))))
