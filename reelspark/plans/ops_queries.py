"""Profiles, runs, history and telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelspark.operators import history, profile, runs, telemetry
from reelspark.operators.ordered import HOUR_MS
from reelspark.plans.inputs import KILLS, kills, query, table

WIDTH = 24 * HOUR_MS


def spans(spark, sf):
    return table(spark, sf, "events").select(
        (F.col("user_id") % 2).alias("run_id"), F.col("event_type").alias("step"), F.col("value").alias("duration_s")
    )


@query(
    "profile_stats",
    """SELECT user_id % 2 AS run_id, event_type AS step, count(*) AS count, round(sum(value), 4) AS total,
    round(avg(value), 6) AS avg, min(value) AS min, max(value) AS max FROM events GROUP BY ALL""",
)
def profile_stats(spark, sf):
    out = profile.stats(spans(spark, sf), ["run_id", "step"])
    return out.withColumns({"total": F.round("total", 4), "avg": F.round("avg", 6)})


@query(
    "profile_summary",
    """SELECT event_type AS step, count(*) AS count, round(sum(value), 4) AS total, round(avg(value), 6) AS avg,
    round(sum(value) * 100 / (SELECT sum(value) FROM events), 6) AS percentage, grouping(event_type) = 1 AS is_total
    FROM events GROUP BY ROLLUP (event_type)""",
)
def profile_summary(spark, sf):
    out = profile.summary(spans(spark, sf))
    return out.withColumns({"total": F.round("total", 4), "avg": F.round("avg", 6), "percentage": F.round("percentage", 6)})


@query(
    "profile_compare",
    """WITH s AS (SELECT user_id % 2 AS r, event_type AS step, avg(value) AS a FROM events GROUP BY ALL)
    SELECT step, round(x.a, 6) AS avg_a, round(y.a, 6) AS avg_b, round(y.a - x.a, 6) AS delta,
           round((y.a - x.a) * 100 / x.a, 6) AS delta_pct
    FROM (SELECT * FROM s WHERE r = 0) x JOIN (SELECT * FROM s WHERE r = 1) y USING (step)""",
)
def profile_compare(spark, sf):
    run = lambda n: profile.stats(spans(spark, sf).filter(F.col("run_id") == n))
    out = profile.compare(run(0), run(1))
    return out.select("step", *[F.round(c, 6).alias(c) for c in out.columns if c != "step"])


@query(
    "span_pairing",
    f"""WITH {KILLS}, m AS (SELECT video_id % 3 AS run_id, event_type AS step, ts_ms, event_id AS seq,
      CASE WHEN k % 2 = 0 THEN 'start' ELSE 'end' END AS mark FROM kills),
    p AS (SELECT *, lag(mark) OVER w AS pm, lag(ts_ms) OVER w AS pt FROM m WINDOW w AS (PARTITION BY run_id, step ORDER BY ts_ms, seq))
    SELECT run_id, step, ts_ms AS end_ms, CASE WHEN pm = 'start' THEN ts_ms - pt END AS duration_ms,
           coalesce(pm <> 'start', TRUE) AS unmatched FROM p WHERE mark = 'end'""",
)
def span_pairing(spark, sf):
    marks = kills(spark, sf).select(
        (F.col("video_id") % 3).alias("run_id"),
        F.col("event_type").alias("step"),
        "ts_ms",
        F.col("event_id").alias("seq"),
        F.when(F.col("k") % 2 == 0, "start").otherwise("end").alias("mark"),
    )
    return profile.pair_spans(marks)


def results(spark, sf):
    failed = F.col("o_orderstatus") == "F"
    return table(spark, sf, "orders").select(
        (F.col("o_custkey") % 20).alias("batch_id"),
        F.col("o_orderkey").alias("video_id"),
        (~failed).alias("success"),
        (F.col("o_totalprice") % 9).cast("bigint").alias("clips"),
        F.when(failed, F.when(F.col("o_orderkey") % 2 == 0, "detection").otherwise("clips")).alias("failed_stage"),
        F.when(failed, F.col("o_orderpriority")).alias("error"),
    )


@query(
    "batch_summary",
    """WITH r AS (SELECT o_custkey % 20 AS batch_id, o_orderstatus <> 'F' AS success, CAST(floor(o_totalprice % 9) AS BIGINT) AS clips FROM orders),
    u AS (SELECT *, FALSE AS m FROM r UNION ALL SELECT batch_id, TRUE, CAST(sum(clips) AS BIGINT), TRUE FROM r
          WHERE success AND batch_id % 2 = 0 GROUP BY batch_id)
    SELECT batch_id, count(*) FILTER (WHERE success) AS successes, count(*) AS total, bool_or(NOT success) AS any_failed,
           CAST(coalesce(sum(clips) FILTER (WHERE NOT m), 0) AS BIGINT) AS total_clips FROM u GROUP BY batch_id""",
)
def batch_summary(spark, sf):
    r = results(spark, sf)
    merged = r.filter(F.col("success") & (F.col("batch_id") % 2 == 0)).groupBy("batch_id").agg(F.sum("clips").alias("clips"))
    return runs.batch_summary(r, merged)


@query(
    "batch_results",
    """WITH r AS (SELECT o_custkey % 20 AS batch_id, 'video_' || o_orderkey || '.mp4' AS path, o_orderstatus <> 'F' AS success, CAST(floor(o_totalprice % 9) AS BIGINT) AS clips,
        CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'detection' ELSE 'clips' END END AS failed_stage,
        CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS error FROM orders)
    SELECT * FROM r UNION ALL
    SELECT batch_id, 'MERGED', TRUE, CAST(sum(clips) AS BIGINT), NULL, NULL FROM r WHERE success AND batch_id % 2 = 0 GROUP BY batch_id""",
)
def batch_results(spark, sf):
    r = results(spark, sf)
    named = r.select(
        "batch_id", F.format_string("video_%d.mp4", F.col("video_id")).alias("path"), "success", "clips",
        F.when(~F.col("success"), F.col("failed_stage")).alias("failed_stage"), F.when(~F.col("success"), F.col("error")).alias("error"),
    )
    merged = r.filter(F.col("success") & (F.col("batch_id") % 2 == 0)).groupBy("batch_id").agg(F.sum("clips").alias("clips"))
    return runs.batch_results(named, merged)


@query(
    "batch_failures",
    """SELECT o_custkey % 20 AS batch_id, o_orderkey AS video_id,
    CASE WHEN o_orderkey % 2 = 0 THEN 'detection' ELSE 'clips' END AS failed_stage, o_orderpriority AS error
    FROM orders WHERE o_orderstatus = 'F'""",
)
def batch_failures(spark, sf):
    return runs.failures(results(spark, sf))


# stage events: the order key is the sequence, five stages take turns
STAGE_EVENTS = """se AS (SELECT o_custkey AS run_id, (o_orderkey + o_custkey) % 9 AS stage_idx,
  ['metadata','frames','detection','clips','join','audio','report','history','cleanup'][(o_orderkey + o_custkey) % 9 + 1] AS stage,
  CASE (o_orderkey * 7 + o_custkey) % 5 WHEN 0 THEN 'RUNNING' WHEN 1 THEN 'RUNNING' WHEN 2 THEN 'SUCCESS' WHEN 3 THEN 'FAILED' ELSE 'SKIPPED' END AS status,
  o_orderkey / 4.0 AS ts_s, o_orderkey AS seq FROM (SELECT o_orderkey, o_custkey % 400 AS o_custkey FROM orders))"""


def stage_events(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 400).alias("run_id"))
    pick = lambda names, i: F.get(F.array(*[F.lit(n) for n in names]), i.cast("int"))
    return o.select(
        "run_id",
        pick(runs.STAGES, (F.col("o_orderkey") + F.col("run_id")) % 9).alias("stage"),
        pick(["RUNNING", "RUNNING", "SUCCESS", "FAILED", "SKIPPED"], (F.col("o_orderkey") * 7 + F.col("run_id")) % 5).alias("status"),
        (F.col("o_orderkey") / 4.0).cast("double").alias("ts_s"),
        F.col("o_orderkey").alias("seq"),
    )


DURATIONS = f"""{STAGE_EVENTS},
f AS (SELECT run_id, stage_idx, stage, arg_max(status, seq) AS status, max(seq) FILTER (WHERE status = 'RUNNING') AS s,
        max(seq) FILTER (WHERE status IN ('SUCCESS', 'FAILED', 'SKIPPED')) AS e FROM se GROUP BY ALL),
dur AS (SELECT run_id, CAST(stage_idx AS INTEGER) AS stage_idx, stage, status,
        CAST(CASE WHEN e > s THEN (e - s) / 4.0 ELSE 0 END AS DOUBLE) AS duration_s FROM f)"""


@query("stage_durations", f"WITH {DURATIONS} SELECT * FROM dur")
def stage_durations(spark, sf):
    return runs.stage_durations(stage_events(spark, sf))


@query(
    "current_stage",
    f"""WITH {DURATIONS} SELECT run_id, coalesce(arg_min(stage, stage_idx) FILTER (WHERE status = 'RUNNING'), 'unknown') AS current_stage
    FROM dur GROUP BY run_id""",
)
def current_stage(spark, sf):
    return runs.current_stage(runs.stage_durations(stage_events(spark, sf)))


@query(
    "stage_snapshot",
    f"""WITH {DURATIONS}, r AS (SELECT DISTINCT run_id FROM se), g AS (SELECT run_id, unnest(range(6)) AS i FROM r),
    s AS (SELECT g.run_id, CAST(i AS INTEGER) AS stage_idx, ['metadata','frames','detection','clips','join','audio'][i + 1] AS stage,
          coalesce(lower(status), 'pending') AS status FROM g LEFT JOIN dur ON dur.run_id = g.run_id AND dur.stage_idx = i)
    SELECT *, coalesce(arg_max(stage, stage_idx) FILTER (WHERE status = 'running') OVER (PARTITION BY run_id), '') AS current_stage FROM s""",
)
def stage_snapshot(spark, sf):
    return telemetry.stage_snapshot(stage_events(spark, sf))


@query(
    "history_retention",
    """WITH f AS (SELECT o_custkey % 10 AS dir, CASE WHEN o_orderkey % 11 = 0 THEN 'notes_' WHEN o_orderkey % 2 = 0 THEN 'config_' ELSE 'results_' END
      || o_orderkey AS name, o_orderdate AS mtime FROM orders),
    a AS (SELECT *, epoch_us(TIMESTAMP '2001-08-02') - epoch_us(mtime) AS age FROM f WHERE name NOT LIKE 'notes%'),
    r AS (SELECT *, age > 1500 * 86400000000 AS old FROM a),
    n AS (SELECT *, row_number() OVER (PARTITION BY dir, old ORDER BY mtime DESC, name DESC) AS rn FROM r)
    SELECT dir, name, mtime, age / 86400000000 AS age_days,
           CASE WHEN old THEN 'expired' WHEN rn > 100 THEN 'excess' ELSE 'keep' END AS verdict FROM n""",
)
def history_retention(spark, sf):
    key = F.col("o_orderkey")
    files = table(spark, sf, "orders").select(
        (F.col("o_custkey") % 10).alias("dir"),
        F.concat(F.when(key % 11 == 0, "notes_").when(key % 2 == 0, "config_").otherwise("results_"), key).alias("name"),
        F.col("o_orderdate").alias("mtime"),
    )
    return history.retention(files, F.lit("2001-08-02").cast("timestamp"), keep_days=1500, max_files=100)


MESSAGES = """msg AS (SELECT user_id % 10 AS task_id, event_id AS seq, CASE WHEN event_type = 'error' THEN 'error' ELSE 'progress' END AS type,
  CASE WHEN event_type = 'view' THEN 'video_' || user_id END AS current_video,
  CASE WHEN event_type = 'click' THEN CAST(round(value * 100) AS BIGINT) END AS detection_progress,
  CASE WHEN event_type = 'signup' THEN event_id % 97 END AS detected_kills,
  CASE WHEN event_type = 'error' AND event_id % 4 > 0 THEN 'WARNING' END AS level,
  CASE WHEN event_type = 'error' AND event_id % 5 > 0 THEN 'message ' || event_id END AS message FROM events)"""


def messages(spark, sf):
    e = table(spark, sf, "events")
    kind = lambda k, v: F.when(F.col("event_type") == k, v)
    eid = F.col("event_id")
    return e.select(
        (F.col("user_id") % 10).alias("task_id"),
        eid.alias("seq"),
        kind("error", "error").otherwise("progress").alias("type"),
        kind("view", F.concat(F.lit("video_"), "user_id")).alias("current_video"),
        kind("click", F.round(F.col("value") * 100).cast("bigint")).alias("detection_progress"),
        kind("signup", eid % 97).alias("detected_kills"),
        kind("error", F.when(eid % 4 > 0, "WARNING")).alias("level"),
        kind("error", F.when(eid % 5 > 0, F.concat(F.lit("message "), eid))).alias("message"),
    )


SOME_FIELDS = ("current_video", "detection_progress", "detected_kills")


@query(
    "latest_progress",
    f"""WITH {MESSAGES} SELECT task_id, arg_max(current_video, seq) AS current_video, arg_max(detection_progress, seq) AS detection_progress,
    arg_max(detected_kills, seq) AS detected_kills FROM msg WHERE type = 'progress' GROUP BY task_id""",
)
def latest_progress(spark, sf):
    return telemetry.latest_progress(messages(spark, sf), SOME_FIELDS)


@query(
    "error_tail",
    f"""WITH {MESSAGES}, r AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY seq DESC) AS n FROM msg WHERE type = 'error')
    SELECT task_id, seq, coalesce(level, 'ERROR') AS level, coalesce(message, '') AS message FROM r WHERE n <= 50 AND seq > 100""",
)
def error_tail(spark, sf):
    return telemetry.error_tail(messages(spark, sf), 50, since=100)


@query(
    "task_status",
    """WITH t AS (SELECT c_custkey AS task_id, c_custkey % 7 = 0 AS cancelled FROM customer),
    r AS (SELECT o_custkey AS task_id, NOT bool_or(o_orderstatus = 'F' AND o_totalprice > 400000) AS success, 'spent ' || count(*) AS error
          FROM orders GROUP BY o_custkey)
    SELECT task_id, CASE WHEN cancelled THEN 'cancelled' WHEN success IS NULL THEN 'failed' WHEN success THEN 'completed' ELSE 'failed' END AS status,
      CASE WHEN cancelled THEN NULL WHEN success IS NULL THEN 'Process ended unexpectedly' WHEN NOT success THEN error END AS error
    FROM t LEFT JOIN r USING (task_id)""",
)
def task_status(spark, sf):
    tasks = table(spark, sf, "customer").select(F.col("c_custkey").alias("task_id"), (F.col("c_custkey") % 7 == 0).alias("cancelled"))
    failed = (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 400_000)
    outcome = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("task_id")).agg(
        (~F.bool_or(failed)).alias("success"), F.concat(F.lit("spent "), F.count(F.lit(1))).alias("error")
    )
    return telemetry.task_status(tasks, outcome)

