"""Results of whole runs and of their stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The stages in order, and the ones a dashboard shows.
STAGES = ("metadata", "frames", "detection", "clips", "join", "audio", "report", "history", "cleanup")
SHOWN_STAGES = STAGES[:6]
FINAL = ("SUCCESS", "FAILED", "SKIPPED")


def stage_dim(spark, names=STAGES) -> DataFrame:
    rows = ", ".join(f"({i}, '{name}')" for i, name in enumerate(names))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(stage_idx, stage)")


#: Fixed value: the path under which the merged edit of a batch stands among its videos.
MERGED = "MERGED"


def batch_results(results: DataFrame, merged: DataFrame | None = None) -> DataFrame:
    """(batch_id, path, success, clips, failed_stage, error): a row per video, then one under ``MERGED`` for each merged edit.

    ``results(batch_id, path, success, clips, failed_stage, error)``; ``merged(batch_id, clips)`` holds the batches that were merged.
    """
    none = F.lit(None).cast("string")
    rows = results.select("batch_id", "path", "success", "clips", "failed_stage", "error")
    if merged is None:
        return rows
    return rows.unionByName(merged.select("batch_id", F.lit(MERGED).alias("path"), F.lit(True).alias("success"), "clips", none.alias("failed_stage"), none.alias("error")))


def batch_summary(results: DataFrame, merged: DataFrame | None = None) -> DataFrame:
    """Per batch: successes, total, any_failed, total_clips.

    ``results(batch_id, video_id, success, clips)``; ``merged(batch_id, clips)`` counts the merged edit as one more
    success; ``batch_results`` lists it.
    """
    rows = results.select("batch_id", "success", "clips", F.lit(False).alias("merged"))
    if merged is not None:
        rows = rows.unionByName(
            merged.select("batch_id", F.lit(True).alias("success"), "clips", F.lit(True).alias("merged"))
        )
    video = ~F.col("merged")
    return rows.groupBy("batch_id").agg(
        F.count_if(F.col("success")).alias("successes"),
        F.count(F.lit(1)).alias("total"),
        F.bool_or(~F.col("success")).alias("any_failed"),
        F.coalesce(F.sum(F.when(video, F.col("clips"))), F.lit(0)).alias("total_clips"),
    )


def failures(results: DataFrame) -> DataFrame:
    """Failed videos with the stage and error."""
    return results.filter(~F.col("success")).select("batch_id", "video_id", "failed_stage", "error")


def stage_durations(events: DataFrame) -> DataFrame:
    """Per run and stage: latest status and seconds from RUNNING to the terminal status.

    ``events(run_id, stage, status, ts_s, seq)``. A stage that ends without having started lasted 0.
    """
    started = F.max_by("ts_s", F.when(F.col("status") == "RUNNING", F.col("seq")))
    ended = F.max_by("ts_s", F.when(F.col("status").isin(*FINAL), F.col("seq")))
    last_end = F.max(F.when(F.col("status").isin(*FINAL), F.col("seq")))
    last_start = F.max(F.when(F.col("status") == "RUNNING", F.col("seq")))
    folded = events.groupBy("run_id", "stage").agg(
        F.max_by("status", "seq").alias("status"),
        started.alias("started"),
        ended.alias("ended"),
        last_start.alias("start_seq"),
        last_end.alias("end_seq"),
    )
    finished = (F.col("end_seq") > F.col("start_seq")) & F.col("ended").isNotNull()
    return folded.join(F.broadcast(stage_dim(events.sparkSession)), "stage").select(
        "run_id",
        "stage_idx",
        "stage",
        "status",
        F.coalesce(F.when(finished, F.col("ended") - F.col("started")), F.lit(0.0)).alias("duration_s"),
    )


def current_stage(durations: DataFrame) -> DataFrame:
    """First running stage of each run, ``unknown`` for none."""
    running = F.when(F.col("status") == "RUNNING", F.col("stage_idx"))
    return durations.groupBy("run_id").agg(
        F.coalesce(F.min_by("stage", running), F.lit("unknown")).alias("current_stage")
    )
