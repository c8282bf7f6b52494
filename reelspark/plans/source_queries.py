"""Scalars, parsers of outside documents, record shapes of the sinks, and the streaming path."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from reelspark.functions import color, fmt, hashing, parse, roi
from reelspark.operators import profile, report
from reelspark.plans.clip_queries import MERGED, numbered_clips
from reelspark.plans.inputs import HOUR, KILLS, MULTI_S, POST_S, PRE_S, kills, query, settings, table
from reelspark.plans.ops_queries import MESSAGES, SOME_FIELDS
from reelspark.session import shared_folder, tune
from reelspark.sources import ingest, sinks
from reelspark.streaming import live

# --- scalars --------------------------------------------------------------------------------------------------


@query(
    "formatters",
    f"""WITH {KILLS} SELECT event_id,
    printf('%02d:%02d:%02d', (c * 10) // 3600, (c * 10) % 3600 // 60, (c * 10) % 60) AS duration,
    CASE WHEN k % 2 = 0 THEN '00:00:00' ELSE printf('%02d:%02d:%02d', c // 3600, c % 3600 // 60, c % 60) END AS odd_duration,
    printf('%02d:%02d:%02d.%03d', ts_ms // 3600000 % 24, ts_ms // 60000 % 60, ts_ms // 1000 % 60, ts_ms % 1000) AS clock,
    CASE WHEN c < 1024 THEN printf('%.1f B', c::DOUBLE) WHEN c < 1048576 THEN printf('%.1f KB', c / 1024.0::DOUBLE)
         ELSE printf('%.1f MB', c / 1048576.0::DOUBLE) END AS size FROM kills""",
)
def formatters(spark, sf):
    c = F.col("c")
    odd = F.when(F.col("k") % 4 == 0, "nope").when(F.col("k") % 4 == 2, "-5").otherwise(c.cast("string"))
    return kills(spark, sf).select(
        "event_id",
        fmt.duration(c * 10).alias("duration"),
        fmt.duration(odd).alias("odd_duration"),
        fmt.ms(F.col("ts_ms")).alias("clock"),
        fmt.size(c).alias("size"),
    )


@query(
    "parsers",
    f"""WITH {KILLS} SELECT event_id,
    CASE k % 4 WHEN 0 THEN c / 1001.0::DOUBLE WHEN 1 THEN 0.0 WHEN 2 THEN CAST(c AS DOUBLE) ELSE 0.0 END AS fps,
    CASE WHEN k % 3 > 0 THEN c END AS width, CASE WHEN k % 3 > 0 THEN k END AS height,
    CASE WHEN k % 3 = 0 THEN 0.25 ELSE c / 100.0::DOUBLE END AS number,
    CASE k % 5 WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 2 THEN TRUE WHEN 3 THEN FALSE ELSE TRUE END AS flag FROM kills""",
)
def parsers(spark, sf):
    c, k = F.col("c"), F.col("k")
    pick = lambda n, *vals: F.get(F.array(*vals), (k % n).cast("int"))
    rate = pick(4, F.concat(c, F.lit("/1001")), F.concat(c, F.lit("/0")), c.cast("string"), F.lit("x/y"))
    size = F.when(k % 3 > 0, F.concat(c, F.lit("x"), k)).otherwise("1920*1080")
    number = F.when(k % 3 == 0, "n/a").otherwise((c / 100.0).cast("string"))
    flag = pick(5, F.lit(" YES "), F.lit("off"), F.lit("1"), F.lit("False"), F.lit("maybe"))
    parsed = parse.resolution(size)
    return kills(spark, sf).select(
        "event_id",
        parse.fps(rate).alias("fps"),
        parsed["width"].alias("width"),
        parsed["height"].alias("height"),
        parse.as_float(number, 0.25).alias("number"),
        parse.as_bool(flag, True).alias("flag"),
    )


@query(
    "hashes",
    f"""WITH {KILLS} SELECT event_id, substr(sha256('/videos/' || video_id || '/' || ts_ms || '.mp4'), 1, 8) AS path_hash,
    substr(sha256('/videos/' || video_id), 1, 16) AS stable_hash FROM kills""",
)
def hashes(spark, sf):
    folder = F.concat(F.lit("/videos/"), "video_id")
    return kills(spark, sf).select(
        "event_id",
        hashing.path_hash(F.concat(folder, F.lit("/"), "ts_ms", F.lit(".mp4"))).alias("path_hash"),
        hashing.stable_hash(folder).alias("stable_hash"),
    )


def _joined(array, digits=4):
    return F.array_join(F.transform(array, lambda v: F.format_string(f"%.{digits}f", v.cast("double"))), ",")


ROI = """r AS (SELECT *, (c % 130 - 10) / 100.0 AS x, (k % 110) / 100.0 AS y, (c % 70) / 100.0 AS w, (k % 60) / 100.0 AS h FROM kills),
n AS (SELECT *, greatest(0.0, least(1.0, x)) AS cx, greatest(0.0, least(1.0, y)) AS cy FROM r),
m AS (SELECT *, greatest(0.0, least(1.0 - cx, w)) AS cw, greatest(0.0, least(1.0 - cy, h)) AS ch FROM n),
p AS (SELECT *, CAST(trunc(CAST(x AS DOUBLE) * 1920) AS BIGINT) AS px, CAST(trunc(CAST(y AS DOUBLE) * 1080) AS BIGINT) AS py,
       CAST(trunc(CAST(w AS DOUBLE) * 1920) AS BIGINT) AS pw, CAST(trunc(CAST(h AS DOUBLE) * 1080) AS BIGINT) AS ph FROM m)"""


@query(
    "roi_scalars",
    f"""WITH {KILLS}, {ROI} SELECT event_id,
    CASE WHEN k % 5 = 0 THEN '0.0000,0.0000,1.0000,1.0000' ELSE printf('%.4f,%.4f,%.4f,%.4f', x::DOUBLE, y::DOUBLE, w::DOUBLE, h::DOUBLE) END AS plain,
    CASE WHEN k % 5 = 0 OR cw <= 0 OR ch <= 0 THEN '0.0000,0.0000,1.0000,1.0000'
         ELSE printf('%.4f,%.4f,%.4f,%.4f', cx::DOUBLE, cy::DOUBLE, cw::DOUBLE, ch::DOUBLE) END AS clamped,
    px || ',' || py || ',' || pw || ',' || ph AS pixels,
    CASE WHEN least(1920, px + pw) > greatest(0, px) AND least(1080, py + ph) > greatest(0, py)
         THEN greatest(0, px) || ',' || greatest(0, py) || ',' || least(1920, px + pw) || ',' || least(1080, py + ph) END AS clipped
    FROM p""",
)
def roi_scalars(spark, sf):
    c, k = F.col("c"), F.col("k")
    # decimals, so that pixel truncation sees the same numbers everywhere
    dec = lambda col, mod, off=0: ((col % mod - off).cast("decimal(10,2)") / 100).cast("double")
    box = F.array(dec(c, 130, 10), dec(k, 110), dec(c, 70), dec(k, 60))
    given = F.when(k % 5 == 0, F.array(F.lit(0.5))).otherwise(box)
    width, height = F.lit(1920), F.lit(1080)
    pixels = roi.to_pixels(box, width, height)
    text = lambda a: F.array_join(F.transform(a, lambda v: v.cast("string")), ",")
    return kills(spark, sf).select(
        "event_id",
        _joined(roi.normalize(given)).alias("plain"),
        _joined(roi.normalize_clamped(given)).alias("clamped"),
        text(pixels).alias("pixels"),
        text(roi.clip_pixels(pixels, width, height)).alias("clipped"),
    )


@query(
    "bbox_scalars",
    f"""WITH {KILLS}, b AS (SELECT event_id, (c % 1500)::DOUBLE AS x, (k * 9)::DOUBLE AS y, (c % 300 + 1)::DOUBLE AS w, (k % 50 + 1)::DOUBLE AS h FROM kills),
    q AS (SELECT *, greatest(192, least(1152, x)) AS x1, greatest(192, least(1152, x + w)) AS x2,
          greatest(108, least(648, y)) AS y1, greatest(108, least(648, y + h)) AS y2 FROM b)
    SELECT event_id, printf('%.6f,%.6f,%.6f,%.6f', (x1 - 192) / 960, (y1 - 108) / 540, (x2 - x1) / 960, (y2 - y1) / 540) AS relative,
      CAST(x + 7 AS BIGINT) || ',' || CAST(y - 3 AS BIGINT) AS moved FROM q""",
)
def bbox_scalars(spark, sf):
    x, y = (F.col("c") % 1500).cast("double"), (F.col("k") * 9).cast("double")
    w, h = (F.col("c") % 300 + 1).cast("double"), (F.col("k") % 50 + 1).cast("double")
    bbox = F.array(F.array(x, y), F.array(x + w, y), F.array(x + w, y + h), F.array(x, y + h))
    region = F.array(*[F.lit(v) for v in (0.1, 0.1, 0.5, 0.5)])
    moved = roi.shift_bbox(bbox, F.lit(7.0), F.lit(-3.0))
    return kills(spark, sf).select(
        "event_id",
        _joined(roi.relative_box(bbox, region, F.lit(1920), F.lit(1080)), 6).alias("relative"),
        F.concat_ws(",", moved[0][0].cast("bigint").cast("string"), moved[0][1].cast("bigint").cast("string")).alias("moved"),
    )


@query(
    "hsv_bounds",
    f"""WITH {KILLS}, h AS (SELECT event_id, k, c % 180 AS h, k * 2 AS s, c % 256 AS v, k % 12 AS t FROM kills)
    SELECT event_id, CASE k % 4 WHEN 0 THEN '1,2,3' WHEN 1 THEN greatest(0, h - t) || ',' || greatest(0, s - 2 * t) || ',' || greatest(0, v - 2 * t)
        WHEN 2 THEN greatest(0, h - 10) || ',' || greatest(0, s - 20) || ',' || greatest(0, v - 30) END AS low,
      CASE k % 4 WHEN 0 THEN '4,5,6' WHEN 1 THEN least(179, h + t) || ',' || least(255, s + 2 * t) || ',' || least(255, v + 2 * t)
        WHEN 2 THEN least(179, h + 10) || ',' || least(255, s + 20) || ',' || least(255, v + 30) END AS high,
      greatest(0, h - 10) || ',' || greatest(0, s - 50) || ',' || greatest(0, v - 50) AS range_low,
      least(179, h + 10) || ',' || least(255, s + 50) || ',' || least(255, v + 50) AS range_high FROM h""",
)
def hsv_bounds(spark, sf):
    k = F.col("k")
    h, s, v = (F.col("c") % 180).cast("int"), (k * 2).cast("int"), (F.col("c") % 256).cast("int")
    arr = lambda *x: F.array(*[(F.lit(i) if not hasattr(i, "cast") else i).cast("double") for i in x])
    empty = F.array().cast("array<double>")
    explicit = k % 4 == 0
    tolerance = F.when(k % 4 == 1, arr(k % 12)).when(k % 4 == 2, arr(10, 20, 30)).otherwise(arr(1, 2))
    b = color.hsv_bounds(F.when(explicit, arr(1, 2, 3)), F.when(explicit, arr(4, 5, 6)).otherwise(empty), arr(h, s, v), tolerance)
    r = color.hsv_range(h, s, v)
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("bigint").cast("string")), ",")
    return kills(spark, sf).select(
        "event_id",
        text(b["lower"]).alias("low"),
        text(b["upper"]).alias("high"),
        text(r["lower"]).alias("range_low"),
        text(r["upper"]).alias("range_high"),
    )


@query(
    "rgb_to_hsv",
    f"""WITH {KILLS}, px AS (SELECT event_id, c % 256 AS r, (c * 7 + k) % 256 AS g, (c * 13 + event_id) % 256 AS b FROM kills),
    hsv AS (SELECT *, greatest(r, g, b) AS v, greatest(r, g, b) - least(r, g, b) AS d FROM px),
    hs AS (SELECT *, CASE WHEN d = 0 THEN 0.0::DOUBLE WHEN v = r THEN (g - b) / d::DOUBLE WHEN v = g THEN 2 + (b - r) / d::DOUBLE
          ELSE 4 + (r - g) / d::DOUBLE END * 30 AS half FROM hsv)
    SELECT event_id, CAST(floor(CASE WHEN half < 0 THEN half + 180 ELSE half END + 0.5) AS BIGINT) % 180 AS h,
      CASE WHEN v = 0 THEN 0 ELSE CAST(floor(d * 255.0::DOUBLE / v + 0.5) AS BIGINT) END AS s, v FROM hs""",
)
def rgb_to_hsv(spark, sf):
    c = F.col("c")
    channels = (c % 256, (c * 7 + F.col("k")) % 256, (c * 13 + F.col("event_id")) % 256)
    return kills(spark, sf).select("event_id", color.rgb_to_hsv(*channels).alias("p")).select("event_id", "p.*")


# --- documents ------------------------------------------------------------------------------------------------


@query(
    "video_inventory",
    """WITH f AS (SELECT CASE page_id % 3 WHEN 0 THEN '/b/' ELSE '/a/' END || 'v' || page_id // 2 || ['.mp4', '.MKV', '.avi', '.txt', '.Mp4'][page_id % 5 + 1] AS path,
        page_id % 3 AS r, length(html) AS len, page_id FROM pages),
    e AS (SELECT *, regexp_extract(path, '(\\.[^.]+)$') AS ext FROM f),
    k AS (SELECT *, list_position(['.mp4', '.MP4', '.avi', '.AVI', '.mkv', '.MKV', '.mov', '.MOV'], ext) AS rk FROM e WHERE ext IN ('.mp4', '.MKV', '.avi')),
    g AS (SELECT path, min(r * 1000 + rk) AS slot, max(len) AS length FROM k GROUP BY path)
    SELECT path, slot // 1000 AS root_idx, length, row_number() OVER (ORDER BY slot, path) AS seq FROM g""",
)
def video_inventory(spark, sf):
    """The listing logic over a listing derived from the pages table."""
    pid = F.col("page_id")
    exts = F.array(*[F.lit(e) for e in (".mp4", ".MKV", ".avi", ".txt", ".Mp4")])
    files = table(spark, sf, "pages").select(
        F.concat(F.when(pid % 3 == 0, "/b/").otherwise("/a/"), F.lit("v"), F.floor(pid / 2).cast("bigint"), F.get(exts, (pid % 5).cast("int"))).alias("path"),
        F.length("html").cast("bigint").alias("length"),
        (pid % 3).cast("int").alias("root_idx"),
        F.lit(False).alias("explicit"),
    )
    return ingest.inventory_of(files)


@query(
    "video_catalog",
    """WITH f AS (SELECT '/a/' || CASE WHEN page_id % 2 = 0 THEN 'V' ELSE 'v' END || page_id || ['.mp4', '.MKV', '.webm', '.txt', '.Mp4'][page_id % 5 + 1] AS path, length(html) AS length FROM pages)
    SELECT path, split_part(path, '/', 3) AS name, length, CASE WHEN length < 1024 THEN printf('%.1f B', length::DOUBLE)
      ELSE printf('%.1f KB', length / 1024.0::DOUBLE) END AS size_formatted FROM f WHERE path NOT LIKE '%.txt'""",
)
def video_catalog(spark, sf):
    pid = F.col("page_id")
    exts = F.array(*[F.lit(e) for e in (".mp4", ".MKV", ".webm", ".txt", ".Mp4")])
    files = table(spark, sf, "pages").select(
        F.concat(F.lit("/a/"), F.when(pid % 2 == 0, "V").otherwise("v"), pid, F.get(exts, (pid % 5).cast("int"))).alias("path"),
        F.length("html").cast("bigint").alias("length"),
    )
    return ingest.inventory_of(files, ingest.CATALOG_EXTS, order="name")


def probes(spark, sf):
    key = F.col("o_orderkey")
    audio = F.format_string('{"codec_type":"audio","codec_name":"aac","sample_rate":"48000","channels":%d}', key % 3)
    video = F.format_string(
        '{"codec_type":"video","codec_name":"h264","width":1920,"height":1080,"r_frame_rate":"%d/1001","nb_frames":"%s"}',
        key * 1000,
        F.when(key % 2 == 0, "N/A").otherwise(key.cast("string")),
    )
    streams = F.concat_ws(",", F.when(key % 3 > 0, audio), F.when(key % 4 > 0, video))
    doc = F.format_string('{"streams":[%s],"format":{"duration":"%d.5","bit_rate":"%d","format_name":"mp4"}}', streams, key, key * 8)
    return table(spark, sf, "orders").select(key.alias("video_id"), F.when(key % 7 == 0, F.lit('{"streams": [')).otherwise(doc).alias("json"))


@query(
    "video_probe",
    """SELECT o_orderkey AS video_id, 1920 AS width, 1080 AS height, o_orderkey * 1000 / 1001.0::DOUBLE AS fps, o_orderkey + 0.5::DOUBLE AS duration_s,
    o_orderkey * 8 AS bitrate, 'h264' AS codec, CASE WHEN o_orderkey % 2 = 1 THEN o_orderkey END AS total_frames
    FROM orders WHERE o_orderkey % 7 > 0 AND o_orderkey % 4 > 0""",
)
def video_probe(spark, sf):
    return ingest.read_video_probe(probes(spark, sf))[0]


@query(
    "video_probe_rejected",
    """SELECT o_orderkey AS video_id, CASE WHEN o_orderkey % 7 = 0 THEN 'unparsable document' ELSE 'no video stream' END AS reason
    FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 4 = 0""",
)
def video_probe_rejected(spark, sf):
    return ingest.read_video_probe(probes(spark, sf))[1]


@query(
    "audio_probe",
    """SELECT o_orderkey AS video_id, CASE WHEN o_orderkey % 7 = 0 THEN 'probe_failed' WHEN o_orderkey % 3 > 0 THEN 'has_audio' ELSE 'no_audio' END AS audio,
    CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_orderkey + 0.5::DOUBLE END AS duration_s, CASE WHEN o_orderkey % 7 > 0 AND o_orderkey % 3 > 0 THEN o_orderkey % 3 END AS channels
    FROM orders""",
)
def audio_probe(spark, sf):
    return ingest.read_audio_probe(probes(spark, sf)).select("video_id", "audio", "duration_s", "channels")


@query(
    "frame_log",
    f"""WITH {KILLS} SELECT video_id, event_id AS n, ts_ms / 1000.0::DOUBLE AS pts_time, ts_ms + 500 AS ts_ms FROM kills WHERE k % 4 < 3""",
)
def frame_log(spark, sf):
    pts = F.format_string("%.3f", F.col("ts_ms") / 1000.0)
    lines = F.get(
        F.array(
            F.concat(F.lit("[Parsed_showinfo_1 @ 0x1] n: "), "event_id", F.lit(" pts: 1 pts_time:"), pts, F.lit(" fmt:yuv")),
            F.concat(F.lit("[showinfo] n:"), "event_id", F.lit(" pts_time:"), pts),
            F.concat(F.lit("n:"), "event_id", F.lit(" x pts_time: "), pts),
            F.lit("frame= 12 fps=0.0 q=-0.0"),
        ),
        (F.col("k") % 4).cast("int"),
    )
    return ingest.parse_frame_log(kills(spark, sf).select("video_id", lines.alias("line")), offset_ms=500)


@query(
    "logs_without_frames",
    f"""WITH {KILLS} SELECT video_id FROM kills GROUP BY video_id HAVING bool_and(k < 95)""",
)
def logs_without_frames(spark, sf):
    line = F.when(F.col("k") >= 95, F.concat(F.lit("n: 1 pts_time: "), F.col("k"))).otherwise("nothing here")
    lines = kills(spark, sf).select("video_id", line.alias("line"))
    return ingest.logs_without_frames(lines, ingest.parse_frame_log(lines))


@query(
    "keyframe_lines",
    f"""WITH {KILLS} SELECT video_id, ts_ms AS keyframe_ms FROM kills WHERE k % 5 IN (0, 1)""",
)
def keyframe_lines(spark, sf):
    pts = F.format_string("%.3f", F.col("ts_ms") / 1000.0)
    line = F.get(
        F.array(F.concat(pts, F.lit(",K__")), F.concat(F.lit(" "), pts, F.lit(" , _K ,x")), F.concat(pts, F.lit(",___")), F.lit("N/A,K__"), pts),
        (F.col("k") % 5).cast("int"),
    )
    return ingest.read_keyframes(kills(spark, sf).select("video_id", line.alias("line")))


@query(
    "recorded_events",
    f"""WITH {KILLS} SELECT video_id, CASE WHEN k % 6 = 0 THEN 0 ELSE ts_ms END AS ts_ms, CASE WHEN k % 6 = 1 THEN 0.0 ELSE (c % 100) / 100.0::DOUBLE END AS confidence,
    CASE WHEN k % 6 = 2 THEN 'kill' ELSE 'ace' END AS type, CASE WHEN k % 2 = 0 THEN 0.5 WHEN k % 3 = 0 THEN 0.25 END AS ocr FROM kills""",
)
def recorded_events(spark, sf):
    """Round trip of recorded event documents held as text."""
    from reelspark import schemas

    k = F.col("k")
    conf = F.when(k % 6 != 1, ((F.col("c") % 100) / 100.0).cast("string"))
    ts = F.when(k % 6 != 0, F.col("ts_ms").cast("string"))
    meta = F.when(k % 2 == 0, F.struct(F.create_map(F.lit("ocr"), F.lit(0.5)).alias("signals"), F.lit("f.jpg").alias("frame_path")))
    doc = F.to_json(
        F.struct(
            ts.alias("timestamp_ms"), conf.alias("confidence"), F.when(k % 6 != 2, "ace").alias("type"), meta.alias("meta"),
            F.when(k % 3 == 0, F.create_map(F.lit("ocr"), F.lit(0.25))).alias("signals"),
        )
    )
    raw = kills(spark, sf).select("video_id", F.from_json(doc, f"STRUCT<{_struct(schemas.EVENT_DOC)}>").alias("d")).select("video_id", "d.*")
    events = ingest.coerce_events(raw)
    return events.select("video_id", "ts_ms", "confidence", "type", F.try_element_at("signals", F.lit("ocr")).alias("ocr"))


def _struct(ddl: str) -> str:
    """Top-level ``name TYPE`` pairs -> ``name:TYPE``."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(ddl + ","):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            name, kind = ddl[start:i].strip().split(" ", 1)
            out.append(f"{name}:{kind}")
            start = i + 1
    return ",".join(out)


@query(
    "clip_metadata",
    f"""WITH {MERGED} SELECT id, CASE WHEN id % 3 = 1 THEN 'p/' || id ELSE 'o/' || id END AS clip_path, start_ms, end_ms, kill_count FROM clips WHERE id % 3 > 0""",
)
def clip_metadata(spark, sf):
    i = F.col("id")
    raw = numbered_clips(spark, sf).select(
        "id", F.when(i % 3 == 1, F.concat(F.lit("p/"), i)).otherwise("").alias("path"),
        F.when(i % 3 > 0, F.concat(F.lit("o/"), i)).alias("output_path"), "start_ms", "end_ms", "kill_count", "kill_type",
        "filename", F.lit(None).cast("string").alias("source_video"),
    )
    valid, _ = ingest.split_clip_metadata(raw)
    return valid.select("id", "clip_path", "start_ms", "end_ms", "kill_count")


@query(
    "clip_metadata_rejected",
    f"""WITH {MERGED} SELECT 'clip ' || id || ' has no path' AS error FROM clips WHERE id % 3 = 0""",
)
def clip_metadata_rejected(spark, sf):
    i = F.col("id")
    raw = numbered_clips(spark, sf).select(
        "id", F.when(i % 3 > 0, F.concat(F.lit("p/"), i)).otherwise("").alias("path"), F.lit(None).cast("string").alias("output_path"),
        "start_ms", "end_ms", "kill_count", "kill_type", "filename", F.lit(None).cast("string").alias("source_video"),
    )
    return ingest.split_clip_metadata(raw)[1]


@query(
    "checkpoint_documents",
    """WITH c AS (SELECT c_custkey AS v, c_custkey % 4 = 0 AS broken, c_custkey % 2 = 0 AS has_bak FROM customer)
    SELECT '/ck/' || v AS checkpoint_path, broken AS from_backup, CASE WHEN broken THEN 1 ELSE 2 END AS version, 'v/' || v AS saved_path,
    CASE WHEN broken THEN 'FAILED' ELSE 'SUCCESS' END AS frames_status, 'f/' || v AS first_frame, 'o/' || v AS first_clip FROM c""",
)
def checkpoint_documents(spark, sf):
    """Primary documents, a quarter of them cut short, with backups for every other one."""
    v = F.col("c_custkey")
    doc = lambda version, status: F.format_string(
        f'{{"checkpoint_version":{version},"video_path":"v/%d","stages":{{"frames":{{"status":"{status}","duration":1.5}}}},'
        '"results":{"frames":["f/%d"],"clips":[{"output_path":"o/%d"}],"video_info":{"fps":60}}}',
        v, v, v,
    )
    customers = table(spark, sf, "customer")
    primary = customers.select(
        F.format_string("/ck/%d", v).alias("source_path"),
        F.when(v % 4 == 0, F.lit('{"checkpoint_version": 2, ')).otherwise(doc(2, "SUCCESS")).alias("json"),
    )
    backup = customers.filter(v % 2 == 0).select(F.format_string("/ck/%d.bak", v).alias("source_path"), doc(1, "FAILED").alias("json"))
    parsed = ingest.parse_checkpoints(primary.unionByName(backup))
    return parsed.select(
        "checkpoint_path",
        "from_backup",
        "version",
        "saved_path",
        F.try_element_at("stages", F.lit("frames")).alias("frames_status"),
        F.get("frames", F.lit(0)).alias("first_frame"),
        F.get("clips", F.lit(0)).alias("first_clip"),
    )


@query(
    "event_records",
    f"""WITH {KILLS} SELECT video_id, ts_ms AS timestamp_ms, 'kill' AS type, round_even((c % 97) / 96.0::DOUBLE, 3) AS confidence, '' AS frame_path FROM kills""",
)
def event_records(spark, sf):
    """Shape of recorded events (the write-time stamp left out)."""
    events = kills(spark, sf).select(
        "video_id", "ts_ms", F.lit(None).cast("string").alias("type"), ((F.col("c") % 97) / 96.0).alias("confidence"),
        F.create_map(F.lit("ocr"), F.lit(1.0)).alias("signals"),
    )
    return sinks.event_records(events).select("video_id", "timestamp_ms", "type", "confidence", "meta.frame_path")


@query(
    "clip_records",
    f"""WITH {MERGED} SELECT video_id, id, start_ms, end_ms, kill_count, kill_type, start_ms / 1000.0::DOUBLE AS start, end_ms / 1000.0::DOUBLE AS "end",
    'out/clip_' || lpad(CAST(id AS VARCHAR), 3, '0') || '_' || kill_type || '_' || CAST(start_ms // 1000 AS VARCHAR) || 's.mp4' AS output_path FROM clips""",
)
def clip_records(spark, sf):
    return sinks.clip_records(numbered_clips(spark, sf), "out").drop("path", "filename")


@query(
    "video_stats",
    """SELECT c_custkey AS video_id, CASE c_custkey % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'old' ELSE 'Unknown' END AS video_path,
    CASE WHEN c_custkey % 2 = 0 THEN 1280 WHEN c_custkey % 5 = 0 THEN 0 ELSE c_custkey END AS width,
    CASE WHEN c_custkey % 2 = 0 THEN 720 WHEN c_custkey % 5 = 0 THEN 0 ELSE 9 END AS height,
    CASE WHEN c_custkey % 4 = 0 THEN 0.0 ELSE 60.0 END AS fps,
    CASE WHEN c_custkey % 3 = 0 THEN '1h' WHEN c_custkey % 3 = 1 THEN printf('%02d:%02d:%02d', c_custkey // 3600, c_custkey % 3600 // 60, c_custkey % 60)
         ELSE '00:00:00' END AS duration_str FROM customer""",
)
def video_stats(spark, sf):
    v = F.col("c_custkey")
    third = lambda a, b, c: F.when(v % 3 == 0, a).when(v % 3 == 1, b).otherwise(c)
    none = F.lit(None).cast("string")
    info = table(spark, sf, "customer").select(
        v.alias("video_id"),
        third(F.lit("new"), none, F.lit("")).alias("video_path"),
        third(F.lit("x"), F.lit("old"), none).alias("path"),
        F.when(v % 2 == 0, 1280).otherwise(0).alias("width"),
        F.when(v % 2 == 0, 720).alias("height"),
        F.when(v % 5 == 0, "?").otherwise(F.concat(v, F.lit("x9"))).alias("resolution"),
        F.when(v % 4 > 0, 60.0).alias("fps"),
        third(F.lit("1h"), F.lit(""), none).alias("duration_str"),
        third(none, v.cast("string"), none).alias("duration"),
    )
    return report.video_stats(info)


# --- what a run leaves behind, written twice ------


def _home(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@query(
    "profile_documents",
    f"""WITH {KILLS} SELECT CAST(video_id % 7 AS VARCHAR) AS run, event_type AS step, count(*) AS count, CAST(sum(c) AS DOUBLE) AS total,
    CAST(round(avg(c), 6) AS DOUBLE) AS avg, CAST(min(c) AS DOUBLE) AS min, CAST(max(c) AS DOUBLE) AS max FROM kills GROUP BY 1, 2""",
)
def profile_documents(spark, sf):
    """Profiles of runs as documents, one run written again, read back."""
    steps = kills(spark, sf).select((F.col("video_id") % 7).cast("string").alias("run"), F.col("event_type").alias("step"), F.col("c").cast("double").alias("duration_s"))
    stats, home = profile.stats(steps, ["run", "step"]), _home(spark, "profiles")
    sinks.write_profile_documents(stats, home)
    sinks.write_profile_documents(stats.filter(F.col("run") == "3"), home)
    back = ingest.read_profiles(spark, home).withColumn("run", F.regexp_extract("source_path", "run=([^/]+)/", 1))
    return back.drop("source_path").withColumn("avg", F.round("avg", 6))


@query(
    "run_history",
    f"""WITH {KILLS}, r AS (SELECT video_id, count(*) AS clips, max(k) AS score FROM kills GROUP BY video_id),
    t AS (SELECT unnest(['20240101_000000', '20240102_000000']) AS run_ts)
    SELECT run_ts, 'results' AS kind, video_id, clips, score FROM r, t
    UNION ALL SELECT run_ts, 'config', NULL, NULL, 9 FROM t""",
)
def run_history(spark, sf):
    """Results and settings of two runs in the history, one of them recorded twice, read back."""
    results = kills(spark, sf).groupBy("video_id").agg(F.count(F.lit(1)).alias("clips"), F.max("k").alias("score"))
    config, home = spark.range(1).select(F.lit(9).cast("bigint").alias("score")), _home(spark, "history")
    for run in ("20240101_000000", "20240102_000000", "20240101_000000"):
        sinks.append_history(results, config, run, home)
    read = lambda kind: spark.read.schema("video_id bigint, clips bigint, score bigint, run_ts string").json(f"{home}/{kind}").withColumn("kind", F.lit(kind))
    return read("results").unionByName(read("config")).select("run_ts", "kind", "video_id", "clips", "score")


# --- streaming ------------------------------------------------------------------------------------------------


def _replay(spark, sf):
    """The events table as a stream of files."""
    schema = tune(spark).read.parquet(f"{sf}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")


def _drain(stream, mode: str):
    """Run a stream over everything available and return what it wrote, with the micro-batch as ``batch``.

    Each micro-batch writes its own folder, so a repeated one replaces itself.
    """
    spark = stream.sparkSession
    home = f"{shared_folder(spark)}/live-{uuid.uuid4().hex[:12]}"

    def write(rows, batch_id):
        rows.write.mode("overwrite").parquet(f"{home}/out/batch={batch_id}")

    run = (
        stream.writeStream.foreachBatch(write).outputMode(mode)
        .option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return spark.read.parquet(f"{home}/out")


def _kill_stream(spark, sf):
    from reelspark.plans.inputs import EPOCH_MS, micros

    return _replay(spark, sf).select(
        F.col("user_id").alias("video_id"), (F.floor(micros(F.col("ts")) / 1000).cast("bigint") - EPOCH_MS).alias("ts_ms"),
        "event_id", "event_type", F.round(F.col("value") * 100).cast("bigint").alias("c"),
    )


@query(
    "stream_clips",
    f"""WITH {MERGED}, wm AS (SELECT max(ts_ms) - {HOUR} AS w FROM kills)
    SELECT video_id, start_ms, end_ms, kill_count, kill_type FROM clips, wm WHERE last_ts_ms + {4 * HOUR} <= w""",
)
def stream_clips(spark, sf):
    """Clips closed by the watermark after replaying all events in one micro-batch per file."""
    closed = live.clips(_kill_stream(spark, sf), PRE_S, POST_S, "1 hour", MULTI_S)
    return _drain(closed, "append").select("video_id", "start_ms", "end_ms", "kill_count", "kill_type")


@query(
    "stream_detect",
    f"""WITH {KILLS}, s AS (SELECT video_id, event_id, (c % 41) / 1000.0 AS pct, (c % 97) / 96.0 AS t FROM kills)
    SELECT video_id, event_id, round(t * 0.3 + least(pct * 50, 1.0) * 0.2, 6) AS confidence FROM s
    WHERE pct >= 0.01 AND t * (0.3 / 1.0) + least(pct * 50, 1.0) * (0.2 / 1.0) >= 0.4""",
)
def stream_detect(spark, sf):
    from reelspark.functions import fusion

    pct = (F.col("c") % 41) / 1000.0
    frames = _kill_stream(spark, sf).withColumns(
        {"color_pct": pct, "signals": fusion.signals(0.0, (F.col("c") % 97) / 96.0, fusion.color_signal(pct), 0.0)}
    )
    events = live.detect(frames, settings(confidence_threshold=0.4))
    return _drain(events, "append").select("video_id", "event_id", F.round("confidence", 6).alias("confidence"))


@query(
    "stream_progress",
    f"""WITH {MESSAGES} SELECT task_id, arg_max(current_video, seq) AS current_video, arg_max(detection_progress, seq) AS detection_progress,
    arg_max(detected_kills, seq) AS detected_kills FROM msg WHERE type = 'progress' GROUP BY task_id""",
)
def stream_progress(spark, sf):
    """The last update of every task from the update-mode stream."""
    stream = _replay(spark, sf)
    kind = lambda k, v: F.when(F.col("event_type") == k, v)
    updates = stream.select(
        (F.col("user_id") % 10).alias("task_id"), F.col("event_id").alias("seq"),
        kind("error", "error").otherwise("progress").alias("type"),
        kind("view", F.concat(F.lit("video_"), "user_id")).alias("current_video"),
        kind("click", F.round(F.col("value") * 100).cast("bigint")).alias("detection_progress"),
        kind("signup", F.col("event_id") % 97).alias("detected_kills"),
    )
    seen = _drain(live.latest_progress(updates, SOME_FIELDS), "update")
    last = seen.groupBy("task_id").agg(F.max_by(F.struct(*SOME_FIELDS), "batch").alias("p"))
    return last.select("task_id", "p.*")


@query(
    "stream_error_tail",
    f"""WITH {MESSAGES}, r AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY seq DESC) AS n FROM msg WHERE type = 'error')
    SELECT task_id, seq, coalesce(level, 'ERROR') AS level, coalesce(message, '') AS message FROM r WHERE n <= 20""",
)
def stream_error_tail(spark, sf):
    """The latest errors of every task after messages came in several micro-batches, in no order of time."""
    from reelspark.plans.ops_queries import messages

    home = _home(spark, "messages")
    messages(spark, sf).withColumn("event_time", F.timestamp_seconds(F.col("seq") + 1)).repartition(8).write.parquet(home)
    schema = spark.read.parquet(home).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(home)
    # no message is late for so long a watermark, and no task is forgotten
    seen = _drain(live.error_tail(stream, 20, ttl_ms=10**12, watermark="36500 days"), "update")
    last = seen.groupBy("task_id").agg(F.max("batch").alias("batch"))
    return seen.join(last, ["task_id", "batch"]).select("task_id", "seq", "level", "message")
