"""Timings of processing steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.operators.ordered import BUCKET_ROWS, Run, running


def stats(spans: DataFrame, keys=("step",)) -> DataFrame:
    """count, total, avg, min, max of ``duration_s`` per step."""
    return spans.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"),
        F.sum("duration_s").alias("total"),
        F.avg("duration_s").alias("avg"),
        F.min("duration_s").alias("min"),
        F.max("duration_s").alias("max"),
    )


def summary(spans: DataFrame) -> DataFrame:
    """Steps with their share of the grand total, largest first, and a grand-total row (step NULL) at the end."""
    rows = spans.groupBy("step").agg(F.count(F.lit(1)).alias("count"), F.sum("duration_s").alias("total"))
    rows = rows.rollup("step").agg(F.sum("count").alias("count"), F.sum("total").alias("total"), F.grouping("step").alias("g"))
    grand = spans.agg(F.sum("duration_s").alias("t")).scalar()
    share = F.coalesce(F.try_divide(F.col("total") * 100, grand), F.lit(0.0))
    return rows.select(
        "step",
        F.coalesce("count", F.lit(0)).alias("count"),
        F.coalesce("total", F.lit(0.0)).alias("total"),
        F.try_divide("total", "count").alias("avg"),
        share.alias("percentage"),
        (F.col("g") == 1).alias("is_total"),
    ).orderBy("is_total", F.col("total").desc(), "step")


def pair_spans(marks: DataFrame, *, rows: int = BUCKET_ROWS) -> DataFrame:
    """start/end marks -> spans.

    ``marks(run_id, step, ts_ms, seq, mark)``. A later start overwrites the open one; an end whose previous mark
    is no start yields a row without duration and ``unmatched`` set. Many marks may share an instant, so buckets are
    bounded by ``rows``.
    """
    seen = running(
        marks,
        ["run_id", "step"],
        "ts_ms",
        {"prev": Run("last", F.struct(F.col("mark").alias("mark"), F.col("ts_ms").alias("ts_ms")))},
        rows=rows,
        tie=["seq"],
    )
    opened = F.coalesce(F.col("prev.mark") == "start", F.lit(False))
    return seen.filter(F.col("mark") == "end").select(
        "run_id",
        "step",
        F.col("ts_ms").alias("end_ms"),
        F.when(opened, F.col("ts_ms") - F.col("prev.ts_ms")).alias("duration_ms"),
        (~opened).alias("unmatched"),
    )


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Change of the average per step between two ``stats`` tables, for steps in both."""
    left = a.select("step", F.col("avg").alias("avg_a"))
    right = b.select("step", F.col("avg").alias("avg_b"))
    change = F.col("avg_b") - F.col("avg_a")
    return left.join(right, "step").select(
        "step", "avg_a", "avg_b", change.alias("delta"), F.try_divide(change * 100, "avg_a").alias("delta_pct")
    )
