"""Clips, streaks, cut plans and timelines over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelspark.functions import fmt
from reelspark.operators import clips as C
from reelspark.operators import report, segments, timeline
from reelspark.operators.ordered import HOUR_MS
from reelspark.plans.inputs import HOUR, HOUR_S, KILLS, MULTI_S, ORACLE, POST_S, PRE_S, kills, query, table
from reelspark.session import durable

#: A day of media per scan bucket: the stand-in events are hours apart.
WIDTH = 24 * HOUR_MS

# gaps and islands on padded intervals
MERGED = (
    KILLS
    + f""", seg AS (
  SELECT *, greatest(0, ts_ms - {3 * HOUR}) AS start_ms, ts_ms + {HOUR} AS end_ms FROM kills),
flagged AS (
  SELECT *, max(end_ms) OVER (PARTITION BY video_id ORDER BY start_ms, event_id
                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM seg),
grouped AS (
  SELECT *, sum(CASE WHEN reach IS NULL OR start_ms > reach THEN 1 ELSE 0 END)
            OVER (PARTITION BY video_id ORDER BY start_ms, event_id ROWS UNBOUNDED PRECEDING) AS g FROM flagged),
merged AS (
  SELECT video_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS kill_count,
         min(ts_ms) AS first_ts_ms, max(ts_ms) AS last_ts_ms
  FROM grouped GROUP BY video_id, g),
clips AS (
  SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start_ms) AS id,
         CASE WHEN kill_count < 2 THEN 'single_kill'
              WHEN last_ts_ms - first_ts_ms > {10 * HOUR} THEN 'multiple_kills'
              WHEN kill_count = 2 THEN 'double_kill' WHEN kill_count = 3 THEN 'triple_kill'
              WHEN kill_count = 4 THEN 'quad_kill' WHEN kill_count = 5 THEN 'penta_kill'
              ELSE 'multi_kill' END AS kill_type
  FROM merged)"""
)


def merged(spark, sf):
    return segments.merge(segments.pad(kills(spark, sf), PRE_S, POST_S), width=WIDTH)


def numbered_clips(spark, sf):
    """The clips table, written out once: numbering and everything after it reads it more than once."""
    return C.number(durable(segments.classify(merged(spark, sf), MULTI_S)), width=WIDTH)


@query(
    "clip_merge_by_video",
    f"WITH {MERGED} SELECT video_id, start_ms, end_ms, kill_count, first_ts_ms, last_ts_ms FROM merged",
)
def clip_merge_by_video(spark, sf):
    return merged(spark, sf)


@query(
    "clip_merge_sessions",
    f"WITH {MERGED} SELECT video_id, start_ms, end_ms, kill_count, first_ts_ms, last_ts_ms FROM merged",
)
def clip_merge_sessions(spark, sf):
    return segments.merge_sessions(kills(spark, sf), PRE_S, POST_S, width=WIDTH)


@query(
    "clip_kill_types",
    f"""WITH {MERGED} SELECT video_id, id, start_ms, end_ms, kill_count, kill_type, end_ms - start_ms AS duration_ms,
    'clip_' || lpad(CAST(id AS VARCHAR), 3, '0') || '_' || kill_type || '_' || CAST(start_ms // 1000 AS VARCHAR)
      || 's.mp4' AS filename FROM clips""",
)
def clip_kill_types(spark, sf):
    return numbered_clips(spark, sf).select(
        "video_id", "id", "start_ms", "end_ms", "kill_count", "kill_type", "duration_ms", "filename"
    )


@query(
    "clip_members",
    f"""WITH {MERGED} SELECT video_id, event_id, ts_ms,
    min(start_ms) OVER (PARTITION BY video_id, g) AS clip_start_ms FROM grouped""",
)
def clip_members(spark, sf):
    padded = segments.pad(kills(spark, sf), PRE_S, POST_S)
    return segments.members(padded, width=WIDTH).select("video_id", "event_id", "ts_ms", "clip_start_ms")


@query(
    "kill_type_totals",
    f"WITH {MERGED} SELECT kill_type, count(*) AS clips, CAST(sum(kill_count) AS BIGINT) AS kills FROM clips GROUP BY kill_type",
)
def kill_type_totals(spark, sf):
    """How many single, double ... clips there are: the flagship question."""
    classified = segments.classify(merged(spark, sf), MULTI_S)
    return classified.groupBy("kill_type").agg(
        F.count(F.lit(1)).alias("clips"), F.sum("kill_count").alias("kills")
    )


@query(
    "clip_report_stats",
    f"""WITH {MERGED} SELECT video_id, CASE kill_type WHEN 'single_kill' THEN 'Single Kill'
      WHEN 'multiple_kills' THEN 'Multiple Kills' WHEN 'double_kill' THEN 'Double Kill'
      WHEN 'triple_kill' THEN 'Triple Kill' WHEN 'quad_kill' THEN 'Quad Kill'
      WHEN 'penta_kill' THEN 'Penta Kill' ELSE 'Multi Kill' END AS title,
    count(*) AS clips, CAST(sum(kill_count) AS BIGINT) AS kills FROM clips GROUP BY video_id, kill_type""",
)
def clip_report_stats(spark, sf):
    stats = report.stats(segments.classify(merged(spark, sf), MULTI_S))
    return stats.select("video_id", fmt.title(F.col("kill_type")).alias("title"), "clips", "kills")


@query(
    "report_lines",
    f"""WITH {MERGED},
tot AS (SELECT video_id, count(*) AS clips, CAST(sum(kill_count) AS BIGINT) AS kills FROM clips GROUP BY video_id),
ty AS (SELECT video_id, kill_type, count(*) AS n,
       row_number() OVER (PARTITION BY video_id ORDER BY kill_type) AS r FROM clips GROUP BY video_id, kill_type),
hms AS (SELECT video_id, id, kill_count, kill_type, start_ms, end_ms FROM clips)
SELECT video_id, section, CAST(pos AS BIGINT) AS pos, line FROM (
  SELECT video_id, 0 AS section, unnest(range(12)) AS pos, unnest([
    '# Highlight Processing Report', '', '## 1. Video Statistics',
    '- **Source File**: video_' || video_id || '.mp4', '- **Resolution**: 1920x1080', '- **FPS**: 60.0',
    '- **Duration**: 01:00:0' || (video_id % 10), '', '## 2. Detection Summary',
    '- **Total Kills Detected**: ' || kills, '- **Total Clips Extracted**: ' || clips, '']) AS line FROM tot
  UNION ALL SELECT video_id, 1, 0, '### Breakdown by Kill Type' FROM tot
  UNION ALL SELECT video_id, 1, r, '- ' || CASE kill_type WHEN 'single_kill' THEN 'Single Kill'
      WHEN 'multiple_kills' THEN 'Multiple Kills' WHEN 'double_kill' THEN 'Double Kill'
      WHEN 'triple_kill' THEN 'Triple Kill' WHEN 'quad_kill' THEN 'Quad Kill'
      WHEN 'penta_kill' THEN 'Penta Kill' ELSE 'Multi Kill' END || ': ' || n FROM ty
  UNION ALL SELECT video_id, 1, max(r) + 1, '' FROM ty GROUP BY video_id
  UNION ALL SELECT video_id, 2, unnest(range(3)), unnest(['## 3. Detailed Clips List',
    '| Clip # | Start Time | End Time | Kill Count | Type |', '|---|---|---|---|---|']) FROM tot
  UNION ALL SELECT video_id, 3, id, '| ' || id || ' | ' ||
    printf('%02d:%02d:%02d.%03d', start_ms // 3600000 % 24, start_ms // 60000 % 60, start_ms // 1000 % 60, start_ms % 1000)
    || ' | ' ||
    printf('%02d:%02d:%02d.%03d', end_ms // 3600000 % 24, end_ms // 60000 % 60, end_ms // 1000 % 60, end_ms % 1000)
    || ' | ' || kill_count || ' | ' || CASE kill_type WHEN 'single_kill' THEN 'Single Kill'
      WHEN 'multiple_kills' THEN 'Multiple Kills' WHEN 'double_kill' THEN 'Double Kill'
      WHEN 'triple_kill' THEN 'Triple Kill' WHEN 'quad_kill' THEN 'Quad Kill'
      WHEN 'penta_kill' THEN 'Penta Kill' ELSE 'Multi Kill' END || ' |' FROM hms
  UNION ALL SELECT video_id, 4, 0, '' FROM tot)""",
)
def report_lines(spark, sf):
    return report.lines(report.video_stats(video_info(spark, sf)), numbered_clips(spark, sf))


def video_info(spark, sf):
    vid = F.col("video_id")
    return kills(spark, sf).select("video_id").distinct().select(
        "video_id",
        F.lit(None).cast("string").alias("video_path"),
        F.format_string("video_%d.mp4", "video_id").alias("path"),
        F.lit(None).cast("int").alias("width"),
        F.lit(None).cast("int").alias("height"),
        F.lit("1920x1080").alias("resolution"),
        F.lit(60.0).alias("fps"),
        F.lit("").alias("duration_str"),
        (F.lit(3600) + vid % 10).cast("string").alias("duration"),
    )


@query(
    "report_sections",
    f"""WITH {KILLS}, v AS (SELECT DISTINCT video_id FROM kills),
    logs AS (SELECT video_id, event_id AS n, event_type || ' at ' || ts_ms AS text FROM kills WHERE event_type = 'error')
    SELECT video_id, section, CAST(pos AS BIGINT) AS pos, line FROM (
      SELECT video_id, section, pos + CASE WHEN section = 0 AND pos >= 1 THEN 1 ELSE 0 END AS pos, line FROM ({{REPORT}})
      UNION ALL SELECT video_id, 0, 1, 'Generated on: 2024-03-01 12:00:00' FROM v
      UNION ALL SELECT video_id, 5, unnest([0, 1]), unnest(['## 4. Configuration Summary', '```yaml']) FROM v
      UNION ALL SELECT video_id, 6, unnest([0, 1]), unnest(['detection:', '  interval: ' || video_id]) FROM v
      UNION ALL SELECT video_id, 7, unnest([0, 1]), unnest(['```', '']) FROM v
      UNION ALL SELECT video_id, 8, unnest([0, 1]), unnest(['## 5. Processing Logs', '```']) FROM (SELECT DISTINCT video_id FROM logs)
      UNION ALL SELECT video_id, 9, n, text FROM logs
      UNION ALL SELECT video_id, 10, unnest([0, 1]), unnest(['```', '']) FROM (SELECT DISTINCT video_id FROM logs))""".replace(
        "{REPORT}", ORACLE["report_lines"]
    ),
)
def report_sections(spark, sf):
    """Whole reports, with when they were made, the settings and the logs."""
    info = video_info(spark, sf)
    config = info.select("video_id", F.posexplode(F.array(F.lit("detection:"), F.concat(F.lit("  interval: "), "video_id"))).alias("line_no", "text"))
    logs = kills(spark, sf).filter(F.col("event_type") == "error").select(
        "video_id", F.col("event_id").alias("line_no"), F.concat("event_type", F.lit(" at "), "ts_ms").alias("text")
    )
    made = F.lit("2024-03-01 12:00:00").cast("timestamp")
    return report.lines(report.video_stats(info), numbered_clips(spark, sf), config=config, logs=logs, generated_on=made)


@query(
    "kill_streaks_min2",
    KILLS.join(["WITH ", ""])
    + f""", flagged AS (
  SELECT *, lag(ts_ms) OVER (PARTITION BY video_id ORDER BY ts_ms, event_id) AS prev FROM kills),
grouped AS (
  SELECT *, sum(CASE WHEN prev IS NULL OR ts_ms - prev > {5 * HOUR} THEN 1 ELSE 0 END)
            OVER (PARTITION BY video_id ORDER BY ts_ms, event_id ROWS UNBOUNDED PRECEDING) AS g FROM flagged)
SELECT video_id, greatest(0, min(ts_ms) - {3 * HOUR}) AS start_ms, max(ts_ms) + {HOUR} AS end_ms,
       count(*) AS kill_count, min(ts_ms) AS first_ts_ms, max(ts_ms) AS last_ts_ms
FROM grouped GROUP BY video_id, g HAVING count(*) >= 2""",
)
def kill_streaks_min2(spark, sf):
    return segments.streaks(kills(spark, sf), 5 * HOUR_S, PRE_S, POST_S, min_kills=2, width=WIDTH)


CUT = f"""WITH {MERGED},
kf AS (SELECT DISTINCT video_id, ts_ms AS keyframe_ms FROM kills WHERE event_type = 'view'),
prior AS (
  SELECT c.video_id, c.id, c.start_ms, c.end_ms,
         CASE WHEN k.keyframe_ms >= greatest(0, c.start_ms - {20 * HOUR}) THEN k.keyframe_ms END AS kf
  FROM clips c ASOF LEFT JOIN kf k ON c.video_id = k.video_id AND c.start_ms + 100 >= k.keyframe_ms),
aligned AS (
  SELECT video_id, id, start_ms, end_ms, CASE WHEN start_ms > 0 THEN kf END AS keyframe_ms FROM prior),
moved AS (
  SELECT *, {{copy}} AS copy,
         CASE WHEN {{copy}} AND keyframe_ms < start_ms - 1 THEN keyframe_ms ELSE start_ms END AS cut_start_ms,
         CASE WHEN {{copy}} AND keyframe_ms < start_ms - 1 THEN greatest(1, end_ms - keyframe_ms)
              ELSE end_ms - start_ms END AS cut_duration_ms FROM aligned),
seek AS (
  SELECT *, CASE WHEN keyframe_ms > 0 THEN keyframe_ms ELSE greatest(0, cut_start_ms - 10000) END AS demux_seek_ms
  FROM moved)
SELECT video_id, id, keyframe_ms, copy, cut_start_ms, cut_duration_ms, demux_seek_ms,
       greatest(0, cut_start_ms - demux_seek_ms) AS precise_seek_ms FROM seek"""


def _cut(spark, sf, **how):
    keyframes = kills(spark, sf).filter(F.col("event_type") == "view").select(
        "video_id", F.col("ts_ms").alias("keyframe_ms")
    )
    plan = C.cut_plan(numbered_clips(spark, sf), keyframes, window_s=20 * HOUR_S, width=WIDTH, **how)
    return plan.select(
        "video_id", "id", "keyframe_ms", "copy", "cut_start_ms", "cut_duration_ms", "demux_seek_ms", "precise_seek_ms"
    )


@query("clip_cut_plan", CUT.format(copy="FALSE"))
def clip_cut_plan(spark, sf):
    return _cut(spark, sf)


@query("clip_cut_plan_copy", CUT.format(copy="TRUE"))
def clip_cut_plan_copy(spark, sf):
    return _cut(spark, sf, stream_copy=True, transition="none")


WANTED = 5 * HOUR

TIMELINE = f"""WITH {MERGED}, d AS (
  SELECT video_id, id, end_ms - start_ms AS duration_ms,
         lag(end_ms - start_ms) OVER (PARTITION BY video_id ORDER BY id) AS prev FROM clips),
t AS (
  SELECT *, CASE WHEN prev IS NULL THEN NULL WHEN least(prev, duration_ms) < {WANTED}
                 THEN least(prev, duration_ms) / 2.0 ELSE CAST({WANTED} AS DOUBLE) END AS transition_ms FROM d),
e AS (
  SELECT *, sum(duration_ms - coalesce(transition_ms, 0))
            OVER (PARTITION BY video_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS edit_end_ms FROM t)"""


@query(
    "transition_timeline",
    TIMELINE
    + f""" SELECT video_id, id, duration_ms, transition_ms, CAST(edit_end_ms AS DOUBLE) AS edit_end_ms,
    CASE WHEN transition_ms IS NOT NULL THEN CAST(edit_end_ms - duration_ms AS DOUBLE) END AS offset_ms,
    coalesce(transition_ms < {WANTED}, FALSE) AS shortened FROM e""",
)
def transition_timeline(spark, sf):
    clips = numbered_clips(spark, sf).select("video_id", "id", "duration_ms")
    return timeline.transitions(clips, WANTED)


@query(
    "timeline_chunks",
    f"""WITH RECURSIVE {MERGED}, n AS (SELECT video_id, max(id) AS n FROM clips GROUP BY video_id),
lv AS (SELECT video_id, n, 1 AS level, CAST(4 AS BIGINT) AS span FROM n WHERE n > 1
       UNION ALL SELECT video_id, n, level + 1, span * 4 FROM lv WHERE span < n)
SELECT c.video_id, c.id, lv.level, (c.id - 1) // lv.span AS chunk FROM clips c JOIN lv USING (video_id)""",
)
def timeline_chunks(spark, sf):
    return timeline.segment_chunks(numbered_clips(spark, sf).select("video_id", "id"), 4)


@query(
    "timeline_chunk_durations",
    f"""WITH RECURSIVE {MERGED}, lv AS (
  SELECT video_id, id, CAST(end_ms - start_ms AS DOUBLE) AS duration_ms, 0 AS level,
         count(*) OVER (PARTITION BY video_id) AS parts FROM clips
  UNION ALL
  SELECT video_id, id, duration_ms, level, count(*) OVER (PARTITION BY video_id) AS parts FROM (
    SELECT video_id, chunk + 1 AS id, level + 1 AS level,
           CAST(sum(duration_ms - CASE WHEN prev IS NULL THEN 0
             WHEN least(prev, duration_ms) < {WANTED} THEN least(prev, duration_ms) / 2.0 ELSE {WANTED} END) AS DOUBLE) AS duration_ms
    FROM (SELECT *, lag(duration_ms) OVER (PARTITION BY video_id, chunk ORDER BY id) AS prev
          FROM (SELECT *, (id - 1) // 4 AS chunk FROM lv WHERE parts > 1))
    GROUP BY video_id, chunk, level))
SELECT video_id, id, duration_ms, level FROM lv""",
)
def timeline_chunk_durations(spark, sf):
    return timeline.segment_timeline(numbered_clips(spark, sf), 4, WANTED)


RUNS = """runs AS (
  SELECT o_custkey % 7 AS batch_id, o_custkey AS video_id, o_custkey AS input_order,
         NOT bool_or(o_orderstatus = 'F' AND o_totalprice > {limit}) AS success
  FROM orders GROUP BY o_custkey)"""
ORDERED = """, ok AS ({ok}),
pos AS (SELECT ok.batch_id, ok.input_order, c.video_id, c.id,
        row_number() OVER (PARTITION BY ok.batch_id ORDER BY ok.input_order, c.video_id, c.id) AS position
        FROM clips c JOIN ok USING (video_id))
SELECT batch_id, input_order, video_id, id, position FROM pos"""


def _runs(spark, sf, limit):
    failed = (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > limit)
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("video_id")).agg(
        (~F.bool_or(failed)).alias("success")
    ).select((F.col("video_id") % 7).alias("batch_id"), "video_id", F.col("video_id").alias("input_order"), "success")


def _order(spark, sf, limit, how):
    clips = numbered_clips(spark, sf).select("video_id", "id")
    return timeline.multi_video_order(clips, _runs(spark, sf, limit), how).select(
        "batch_id", "input_order", "video_id", "id", "position"
    )


@query(
    "multi_video_order",
    f"WITH {MERGED}, {RUNS.format(limit=450000)}" + ORDERED.format(ok="SELECT * FROM runs WHERE success"),
)
def multi_video_order(spark, sf):
    return _order(spark, sf, 450_000, "skip")


@query(
    "multi_video_order_stop",
    f"WITH {MERGED}, {RUNS.format(limit=499900)}"
    + ORDERED.format(ok="SELECT * FROM runs WHERE batch_id NOT IN (SELECT batch_id FROM runs WHERE NOT success)"),
)
def multi_video_order_stop(spark, sf):
    return _order(spark, sf, 499_900, "stop")


@query(
    "valid_clips",
    f"""WITH {MERGED}, {RUNS.format(limit=450000)},
named AS (SELECT video_id, id, CASE WHEN id % 3 = 0 THEN '' WHEN id % 3 = 1 THEN 'c/' || id END AS path,
                 CASE WHEN id % 2 = 0 THEN 'o/' || id END AS output_path FROM clips)
SELECT video_id, id, coalesce(nullif(path, ''), nullif(output_path, '')) AS clip_path FROM named
WHERE coalesce(nullif(path, ''), nullif(output_path, '')) IS NOT NULL
  AND video_id IN (SELECT video_id FROM runs WHERE success)""",
)
def valid_clips(spark, sf):
    i = F.col("id")
    named = numbered_clips(spark, sf).select(
        "video_id",
        "id",
        F.when(i % 3 == 0, "").when(i % 3 == 1, F.concat(F.lit("c/"), i)).alias("path"),
        F.when(i % 2 == 0, F.concat(F.lit("o/"), i)).alias("output_path"),
    )
    return C.valid_clips(named, _runs(spark, sf, 450_000)).select("video_id", "id", "clip_path")


@query(
    "music_fit",
    f"""WITH {MERGED}, t AS (SELECT video_id, sum(end_ms - start_ms) / 1000.0 AS target FROM clips GROUP BY video_id),
m AS (SELECT video_id, max(value) * 60 AS music FROM kills GROUP BY video_id)
SELECT video_id, CAST(greatest(1, ceil(target / music)) AS BIGINT) AS loops, music > target AS trimmed,
       CASE WHEN target < 2.0 THEN target * 0.2 ELSE 2.0 END AS fade_s,
       target - CASE WHEN target < 2.0 THEN target * 0.2 ELSE 2.0 END AS fade_start_s
FROM t JOIN m USING (video_id)""",
)
def music_fit(spark, sf):
    target = merged(spark, sf).groupBy("video_id").agg(
        (F.sum(F.col("end_ms") - F.col("start_ms")) / 1000.0).alias("target")
    )
    music = kills(spark, sf).groupBy("video_id").agg((F.max("value") * 60).alias("music"))
    fit = timeline.music_fit(F.col("target"), F.col("music"))
    return target.join(music, "video_id").select("video_id", fit.alias("f")).select("video_id", "f.*")


@query(
    "transition_choices",
    f"""WITH {MERGED}, d AS (
  SELECT video_id, id, CAST('0x' || substr(sha256(video_id || ':' || id), 1, 8) AS BIGINT) % {len(timeline.TRANSITIONS)} AS pick
  FROM clips)
SELECT video_id, id, [{", ".join(f"'{t}'" for t in timeline.TRANSITIONS)}][pick + 1] AS drawn, 'fade' AS fallback FROM d""",
)
def transition_choices(spark, sf):
    """A reproducible random transition per clip."""
    clips = numbered_clips(spark, sf)
    return clips.select(
        "video_id",
        "id",
        timeline.transition_choice("random", F.col("video_id"), F.col("id")).alias("drawn"),
        timeline.transition_choice("unheard-of", F.col("video_id"), F.col("id")).alias("fallback"),
    )
