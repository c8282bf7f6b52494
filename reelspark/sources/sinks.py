"""Writers. Every one is a plain Spark write: atomic per task commit, no driver in the data path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_records(events: DataFrame) -> DataFrame:
    """Events in recorded form: confidence at three decimals, signals and an (always empty) frame path in meta."""
    return events.select(
        "video_id",
        F.col("ts_ms").alias("timestamp_ms"),
        F.coalesce("type", F.lit("kill")).alias("type"),
        F.bround("confidence", 3).alias("confidence"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("recorded_at"),
        F.struct(F.col("signals"), F.lit("").alias("frame_path")).alias("meta"),
    )


def write_events(events: DataFrame, path: str, mode: str = "error") -> None:
    """Events as JSON under ``video_id=...``. Rows are brought together by video first, so a video is a few files, not one for
    every task; a video that fills many partitions is split again, not gathered."""
    event_records(events).hint("rebalance", "video_id").write.mode(mode).partitionBy("video_id").json(path)


def clip_records(clips: DataFrame, output_dir: str = "") -> DataFrame:
    """The ten metadata fields of every clip, plus its video."""
    prefix = f"{output_dir.rstrip('/')}/" if output_dir else ""
    path = F.concat(F.lit(prefix), F.col("filename"))
    return clips.select(
        "video_id",
        "id",
        path.alias("path"),
        "filename",
        "start_ms",
        "end_ms",
        "kill_count",
        "kill_type",
        (F.col("start_ms") / 1000.0).alias("start"),
        (F.col("end_ms") / 1000.0).alias("end"),
        path.alias("output_path"),
    )


def write_clips(clips: DataFrame, path: str, output_dir: str = "", fmt: str = "json", mode: str = "error") -> None:
    clip_records(clips, output_dir).write.mode(mode).format(fmt).save(path)


def write_reports(lines: DataFrame, path: str, mode: str = "error") -> None:
    """Reports as text under ``video_id=...``; a report is its part files in name order.

    Range partitioning on the full line order splits a huge report over tasks instead of gathering it.
    """
    order = ["video_id", "section", "pos"]
    (
        lines.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("video_id", "line")
        .write.mode(mode)
        .partitionBy("video_id")
        .text(path)
    )


def _replacing(rows: DataFrame, *keys: str):
    """A writer that replaces what is there under the keys of ``rows``, so a run that is repeated leaves its rows once."""
    return rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys)


def write_profile(stats: DataFrame, path: str, run: str) -> None:
    """Put one run's step statistics, as rows, beside those of other runs."""
    _replacing(stats.withColumn("run", F.lit(run)), "run").json(path)


def write_profile_documents(stats: DataFrame, path: str) -> None:
    """One profile document per run: ``stats(run, step, count, total, avg, min, max)``; steps are a handful per run."""
    body = F.struct("count", "total", "avg", "min", "max", F.col("step").alias("step_name"))
    entries = F.array_sort(F.collect_list(F.struct(F.col("step").alias("key"), body.alias("value"))))
    documents = stats.groupBy("run").agg(F.to_json(F.map_from_entries(entries)).alias("value"))
    _replacing(documents, "run").text(path)


def append_history(results: DataFrame, config: DataFrame, run_ts: str, path: str) -> None:
    """Put the results and the settings snapshot of a run under its timestamp; the same run again replaces itself."""
    for name, rows in (("results", results), ("config", config)):
        _replacing(rows.withColumn("run_ts", F.lit(run_ts)), "run_ts").json(f"{path.rstrip('/')}/{name}")
