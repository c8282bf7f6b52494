"""How the given tables stand in for the engine's inputs, once as DataFrames and once as SQL for the checks.

An event's user is the video and its instant the media time (milliseconds from 2024-01-01); hours on these tables
stand for the seconds of real footage. ``c`` is the event's value in cents, from which scores are derived.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.operators.keyword_join import KeywordTable, prepare
from reelspark.operators.ordered import laid_out
from reelspark.operators.settings import Detection
from reelspark.session import tune

EPOCH_MS = 1_704_067_200_000
HOUR_S = 3600.0
PRE_S, POST_S, MULTI_S = 3 * HOUR_S, 1 * HOUR_S, 10 * HOUR_S
HOUR = 3_600_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, when given, the SQL that must produce the same rows."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf}/{name}.parquet")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def kills(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as a kill: video_id, ts_ms, event_id, event_type, c, k, value."""
    e = table(spark, sf, "events")
    return e.select(
        F.col("user_id").alias("video_id"),
        (F.floor(micros(F.col("ts")) / 1000).cast("bigint") - EPOCH_MS).alias("ts_ms"),
        "event_id",
        "event_type",
        F.round(F.col("value") * 100).cast("bigint").alias("c"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        "value",
    )


KILLS = f"""kills AS (
  SELECT user_id AS video_id, epoch_us(ts) // 1000 - {EPOCH_MS} AS ts_ms, event_id, event_type,
         CAST(round(value * 100) AS BIGINT) AS c, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value
  FROM events)"""


def frame_signals(spark: SparkSession, sf: str) -> DataFrame:
    """One row per event with color_pct and the signals struct."""
    e = kills(spark, sf)
    c = F.col("c")
    pct = (c % 41) / 1000.0
    ocr = F.when(F.col("event_type") == "purchase", (c % 101) / 100.0).otherwise(0.0)
    yolo = F.when(F.col("event_type") == "click", (c % 89) / 88.0).otherwise(0.0)
    return e.withColumns(
        {
            "color_pct": pct,
            "signals": F.struct(
                ocr.alias("ocr"),
                ((c % 97) / 96.0).alias("template"),
                F.least(pct * 50, F.lit(1.0)).alias("color"),
                yolo.alias("yolo"),
            ),
        }
    )


SIGNALS = (
    KILLS
    + """, sig AS (
  SELECT video_id, ts_ms, event_id, event_type, c, k, value, (c % 41) / 1000.0 AS color_pct,
         CASE WHEN event_type = 'purchase' THEN (c % 101) / 100.0 ELSE 0.0 END AS ocr,
         (c % 97) / 96.0 AS template, least((c % 41) / 1000.0 * 50, 1.0) AS color,
         CASE WHEN event_type = 'click' THEN (c % 89) / 88.0 ELSE 0.0 END AS yolo
  FROM kills)"""
)


def settings(**changes) -> Detection:
    """Settings the detection queries share; keyword arguments replace whole sections."""
    raw = {
        "confidence_threshold": 0.5,
        "weights": {"ocr": 0.4, "template": 0.3, "color": 0.2, "yolo": 0.1},
        "ocr": {"enabled": True, "keywords": ["KILL"]},
        "templates": {"t0": {"threshold": 0.8}, "t1": {"threshold": 0.7}, "t2": {}},
        "colors": {"red": {"hsv": [0, 200, 200], "tolerance": 10}, "blue": {"hsv_lower": [100, 50, 50], "hsv_upper": [130, 255, 255]}},
        "prefilter": {"enabled": True, "color_threshold": 0.01},
    }
    raw.update(changes)
    return Detection.of(raw)


RULES = [
    {"name": "icon_and_object", "enabled": True, "require": ["yolo", "template"]},
    {"name": "text", "enabled": True, "require": ["ocr"]},
    {"name": "off", "enabled": False, "require": ["color"]},
]


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Words of the conversations as text detections; a turn is a frame."""
    words = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("video_id"),
        (F.col("turn") * 1000).alias("ts_ms"),
        F.posexplode(F.split("text", r"\s+")).alias("det_idx", "text"),
    )
    words = words.filter(F.col("text") != "")
    return words.withColumn("confidence", ((F.col("det_idx") * 7 + F.length("text")) % 100) / 100.0)


TOKENS = """tokens AS (
  SELECT video_id, ts_ms, det_idx, text, ((det_idx * 7 + length(text)) % 100) / 100.0 AS confidence
  FROM (SELECT conv_id AS video_id, turn * 1000 AS ts_ms,
               unnest(string_split_regex(text, '\\s+')) AS text,
               generate_subscripts(string_split_regex(text, '\\s+'), 1) - 1 AS det_idx
        FROM conversations)
  WHERE text <> '')"""


def keywords(spark: SparkSession, sf: str) -> KeywordTable:
    """All longer words of the benchmark texts, the most frequent first."""
    words = table(spark, sf, "benchmark").select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("keyword"))
    counted = words.filter(F.length("keyword") >= 4).groupBy("keyword").agg((-F.count(F.lit(1))).alias("less"))
    return prepare(laid_out(counted, [], "less", ["keyword"]).select(F.col("__at").alias("kw_idx"), "keyword"))


KEYWORDS = """keywords AS (
  SELECT keyword, row_number() OVER (ORDER BY n DESC, keyword) - 1 AS kw_idx
  FROM (SELECT keyword, count(*) AS n
        FROM (SELECT unnest(string_split_regex(lower(text), '[^\\p{L}]+')) AS keyword FROM benchmark)
        WHERE length(keyword) >= 4 GROUP BY keyword))"""
