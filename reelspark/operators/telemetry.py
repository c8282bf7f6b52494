"""Folds over progress messages (batch form; ``streaming.live`` has the stateful one)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.operators.ordered import top_per_key
from reelspark.operators.runs import SHOWN_STAGES

#: Fields a progress message may update, with their types.
PROGRESS_FIELDS = {
    "current_video": "string",
    "current_video_index": "bigint",
    "total_videos": "bigint",
    "current_stage": "string",
    "stages": "string",
    "detection_progress": "bigint",
    "detection_total": "bigint",
    "detected_kills": "bigint",
    "extracted_clips": "bigint",
}


def latest_progress(messages: DataFrame, fields=tuple(PROGRESS_FIELDS)) -> DataFrame:
    """Per task, the latest non-null value of every field over ``messages(task_id, seq, type, <fields>)``."""
    updates = messages.filter(F.col("type") == "progress")
    return updates.groupBy("task_id").agg(
        *[F.max_by(f, F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f) for f in fields]
    )


def error_tail(messages: DataFrame, n: int = 50, since: int = 0) -> DataFrame:
    """The latest n error messages per task, of those only the ones after ``seq`` = since."""
    errors = messages.filter(F.col("type") == "error").select(
        "task_id",
        "seq",
        F.coalesce("level", F.lit("ERROR")).alias("level"),
        F.coalesce("message", F.lit("")).alias("message"),
    )
    tail = top_per_key(errors, ["task_id"], [F.col("seq").desc()], n).drop("rank")
    return tail.filter(F.col("seq") > since)


def task_status(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """Final status: cancellation beats any result; no result at all means the task died.

    ``tasks(task_id, cancelled)``, ``results(task_id, success, error)``, at most one per task.
    """
    joined = tasks.join(results, "task_id", "left")
    died = F.col("success").isNull()
    return joined.select(
        "task_id",
        F.when(F.col("cancelled"), "cancelled")
        .when(died, "failed")
        .when(F.col("success"), "completed")
        .otherwise("failed")
        .alias("status"),
        F.when(~F.col("cancelled"), F.when(died, F.lit("Process ended unexpectedly")).when(~F.col("success"), F.col("error"))).alias("error"),
    )


def stage_snapshot(events: DataFrame) -> DataFrame:
    """Latest lower-cased status of every shown stage per run; stages without events are pending.

    ``events(run_id, stage, status, seq)``. Statuses fold into one map per run (bounded by the stage list), so
    runs meet the stage list without a join. ``current_stage`` is the last running one.
    """
    shown = events.filter(F.col("stage").isin(*SHOWN_STAGES))
    latest = shown.groupBy("run_id", "stage").agg(F.lower(F.max_by("status", "seq")).alias("status"))
    folded = latest.groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("stage", "status"))).alias("known"))
    runs = events.select("run_id").distinct().join(folded, "run_id", "left")
    order = F.array(*[F.lit(s) for s in SHOWN_STAGES])
    running = F.filter(order, lambda s: F.try_element_at("known", s) == "running")
    return runs.withColumn("current_stage", F.coalesce(F.try_element_at(running, F.lit(-1)), F.lit(""))).select(
        "run_id", "current_stage", F.posexplode(order).alias("stage_idx", "stage"), "known"
    ).select(
        "run_id",
        "stage_idx",
        "stage",
        F.coalesce(F.try_element_at("known", F.col("stage")), F.lit("pending")).alias("status"),
        "current_stage",
    )

