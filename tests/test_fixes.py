"""Whole trees of joins, NULL keys, quoted numbers, ties, settings."""

import pytest
from pyspark.sql import functions as F

from reelspark.operators import segments, timeline
from reelspark.operators.config import _bad_hsv, _bad_roi
from reelspark.operators.ordered import Run, running
from reelspark.operators.settings import Detection


def joined(durations, size, wanted):
    """Levels of durations, each list the parts of one level, down to the root."""
    levels = [list(map(float, durations))]
    while size and len(levels[-1]) > 1:
        parts, nxt = levels[-1], []
        for at in range(0, len(parts), size):
            chunk = parts[at : at + size]
            total = chunk[0]
            for a, b in zip(chunk, chunk[1:]):
                total += b - (min(a, b) / 2 if min(a, b) < wanted else wanted)
            nxt.append(total)
        levels.append(nxt)
    return levels


@pytest.mark.parametrize("n,size", [(1, 4), (4, 4), (5, 4), (100, 4), (100, 2), (5, 0)])
def test_tree_of_joins_reaches_the_root(spark, n, size):
    durations = [1000 + 37 * i for i in range(n)]
    clips = spark.createDataFrame([(7, i + 1, d) for i, d in enumerate(durations)], "video_id long, id long, duration_ms long")
    rows = timeline.segment_timeline(clips, size, 500).collect()
    want = joined(durations, size, 500)
    assert len(want[-1]) == 1 or size == 0
    assert sorted((r.level, r.id, round(r.duration_ms, 6)) for r in rows) == [(k, i + 1, round(d, 6)) for k, part in enumerate(want) for i, d in enumerate(part)]
    if size:
        chunks = timeline.segment_chunks(clips.select("video_id", "id"), size)
        assert chunks.select("level").distinct().count() == len(want) - 1


def test_null_keys_are_one_key(spark):
    rows = spark.createDataFrame([(None, 0, 5), (None, 3_600_000 * 2, 6)], "k string, t long, v int")
    out = running(rows, ["k"], "t", {"s": Run("sum", F.col("v"), "through")}).collect()
    assert sorted(r.s for r in out) == [5, 11]
    padded = spark.createDataFrame([(None, 0, 1000, 500), (None, 900, 2000, 1500), (1, 0, 10, 5)], "video_id long, start_ms long, end_ms long, ts_ms long")
    assert segments.members(padded).count() == 3


def test_quoted_numbers_are_not_numbers(spark):
    rows = spark.createDataFrame([('["0.1","0.1","0.5","0.5"]',), ("[0.1,0.1,0.5,0.5]",), ('["1","2","3"]',), ("[1,2,3]",)], "v string")
    found = [(r.roi, r.hsv) for r in rows.select(_bad_roi(F.col("v")).alias("roi"), _bad_hsv(F.col("v")).alias("hsv")).collect()]
    assert found[0][0] and found[1][0] is None and found[2][1] and found[3][1] is None


def test_equal_input_order_goes_by_video(spark):
    clips = spark.createDataFrame([(v, i) for v in (5, 3, 9) for i in (1, 2)], "video_id long, id long")
    runs = spark.createDataFrame([(1, v, 0, True) for v in (5, 3, 9)], "batch_id long, video_id long, input_order long, success boolean")
    rows = timeline.multi_video_order(clips, runs).collect()
    assert [(r.video_id, r.id) for r in sorted(rows, key=lambda r: r.position)] == [(3, 1), (3, 2), (5, 1), (5, 2), (9, 1), (9, 2)]


def test_settings_are_lenient_and_layered():
    cfg = Detection.of({"confidence_threshold": "x", "ocr": {"enabled": " Yes ", "threshold": "0.7", "keywords": None}, "templates": {"a": {"threshold": 0.6, "roi": [0, 0, 1, 1]}, "b": 3}, "prefilter": {"enabled": "off"},
                        "rules": [{"name": "r", "require": ["ocr"], "detection_overrides": {"ocr": {"required": True}, "confidence_threshold": 0.9}}, "junk"]})
    assert (cfg.confidence_threshold, cfg.ocr_enabled, cfg.similarity_threshold, cfg.keywords, cfg.prefilter_enabled) == (0.5, True, 0.7, (), False)
    assert cfg.templates == {"a": 0.6, "b": 0.8} and cfg.template_scopes == {"a": "template:a"} and len(cfg.rules) == 1
    own = cfg.effective(cfg.rules[0])
    assert (own.ocr_required, own.ocr_enabled, own.confidence_threshold, own.rules) == (True, True, 0.9, ())
