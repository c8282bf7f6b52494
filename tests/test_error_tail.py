"""The error tail over many micro-batches: late rows, bounded state, forgetting."""

import datetime

from reelspark.operators import telemetry
from reelspark.streaming import live

MESSAGE = "task_id bigint, seq bigint, type string, level string, message string, event_time timestamp"


def drained(spark, tmp_path, batches, **kwargs):
    """Rows of each micro-batch, one input file per batch."""
    home = tmp_path / "in"
    for k, rows in enumerate(batches):
        made = [(t, s, kind, None, f"m{s}", datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=at)) for t, s, kind, at in rows]
        spark.createDataFrame(made, MESSAGE).coalesce(1).write.mode("append").parquet(str(home))
    stream = spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", 1).parquet(str(home))
    out = []

    def keep(rows, batch):
        out.append(sorted((r.task_id, r.seq, r.level) for r in rows.collect()))

    run = live.error_tail(stream, 3, **kwargs).writeStream.foreachBatch(keep).outputMode("update")
    run = run.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination()
    states = [p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]]
    return out, states


def test_tail_over_batches_is_the_batch_tail(spark, tmp_path):
    batches = [[(1, 5, "error", 5), (1, 6, "progress", 6), (2, 7, "error", 7)], [(1, 2, "error", 2), (1, 9, "error", 9)], [(1, 8, "error", 8), (2, 3, "progress", 3)], [(1, 1, "error", 1)]]
    out, _ = drained(spark, tmp_path, batches)
    seen = {}
    for rows in out:
        for task in {t for t, *_ in rows}:
            seen[task] = [r for r in rows if r[0] == task]
    everything = [(t, s, kind, None, "", None) for rows in batches for t, s, kind, _ in rows]
    want = telemetry.error_tail(spark.createDataFrame(everything, MESSAGE), 3).collect()
    assert sorted(r for rows in seen.values() for r in rows) == sorted((r.task_id, r.seq, r.level) for r in want)
    assert seen[1] == [(1, s, "ERROR") for s in (5, 8, 9)]


def test_silent_tasks_are_forgotten(spark, tmp_path):
    batches = [[(1, 1, "error", 10), (2, 2, "error", 10)], [(2, 3, "error", 100)], [(2, 4, "error", 200)], [(2, 5, "error", 300)], [(1, 6, "error", 310)]]
    out, states = drained(spark, tmp_path, batches, ttl_ms=60_000, watermark="5 seconds")
    assert states[0] == 2 and 1 in states[1:]
    # the first task came back without its old errors
    last = [r for rows in out for r in rows if r[0] == 1][-1]
    assert last == (1, 6, "ERROR") and sum(r == (1, 1, "ERROR") for rows in out for r in rows) == 1

