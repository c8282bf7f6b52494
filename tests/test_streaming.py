import pytest
from pyspark.sql import functions as F

from reelspark.operators import segments, telemetry
from reelspark.streaming import live


def drain(stream, mode, tmp_path, name):
    spark = stream.sparkSession
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name))
    run = writer.trigger(availableNow=True).start()
    try:
        assert run.awaitTermination(60)
    finally:
        run.stop()
    return spark.table(name).collect()


def files(spark, tmp_path, rows, schema, parts):
    src = tmp_path / "src"
    for i, part in enumerate(parts):
        spark.createDataFrame([rows[j] for j in part], schema).coalesce(1).write.mode("append").parquet(str(src))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))


def test_closed_clips_equal_batch(spark, tmp_path):
    rows = [(v, t * 1000) for v in (1, 2) for t in (1, 3, 9, 10, 11, 40)] + [(3, 10_000_000)]
    schema = "video_id int, ts_ms bigint"
    stream = files(spark, tmp_path, rows, schema, [range(0, 6), range(6, 12), [12]])
    got = drain(live.clips(stream, 3, 1, "1 minute", 10), "append", tmp_path, "clips_t")
    batch = segments.classify(segments.merge(segments.pad(spark.createDataFrame(rows[:-1], schema), 3, 1)), 10)
    cols = ["video_id", "start_ms", "end_ms", "kill_count", "kill_type"]
    assert sorted(tuple(r[c] for c in cols) for r in got) == sorted(map(tuple, batch.select(cols).collect()))


MSG = "task_id bigint, seq bigint, type string, current_stage string, detected_kills bigint, level string, message string"
MESSAGES = [
    (1, 1, "progress", "frames", None, None, None),
    (1, 2, "progress", None, 4, None, None),
    (1, 3, "error", None, None, None, "first"),
    (2, 4, "progress", "clips", 1, None, None),
    (1, 5, "progress", "clips", None, None, None),
    (1, 6, "error", None, None, "WARNING", None),
    (1, 7, "error", None, None, "ERROR", "third"),
    (2, 8, "progress", None, 9, None, None),
]
FIELDS = ("current_stage", "detected_kills")


@pytest.mark.parametrize("ttl", [None, 3_600_000])
def test_progress_fold(spark, tmp_path, ttl):
    stream = files(spark, tmp_path, MESSAGES, MSG, [range(0, 4), range(4, 8)])
    stream = stream.withColumn("event_time", F.timestamp_millis(F.col("seq") * 1000))
    seen = {}
    for r in drain(live.latest_progress(stream, FIELDS, ttl), "update", tmp_path, f"progress_{ttl}"):
        seen[r.task_id] = (r.current_stage, r.detected_kills)
    batch = telemetry.latest_progress(spark.createDataFrame(MESSAGES, MSG), FIELDS).collect()
    assert seen == {r.task_id: (r.current_stage, r.detected_kills) for r in batch} == {1: ("clips", 4), 2: ("clips", 9)}


def test_error_tail(spark, tmp_path):
    stream = files(spark, tmp_path, MESSAGES, MSG, [range(0, 4), range(4, 8)])
    rows = drain(live.error_tail(stream, 2), "update", tmp_path, "errors_t")
    last = [(r.seq, r.level, r.message) for r in rows][-2:]
    assert last == [(6, "WARNING", ""), (7, "ERROR", "third")]
    batch = telemetry.error_tail(spark.createDataFrame(MESSAGES, MSG), 2).orderBy("seq").collect()
    assert [(r.seq, r.level, r.message) for r in batch] == last
