import json
import random

import pytest
from pyspark.sql import functions as F

from reelspark.operators import config as CF
from reelspark.operators import history, lineage, rules, runs, telemetry


def leaves(doc, prefix=""):
    if isinstance(doc, dict) and doc:
        for k, v in doc.items():
            yield from leaves(v, f"{prefix}.{k}" if prefix else k)
    elif prefix:
        yield prefix, json.dumps(doc, separators=(",", ":"))


def kv(spark, docs, key="game"):
    rows = [(g, p, v) for g, d in docs.items() for p, v in leaves(d)]
    return spark.createDataFrame(rows, f"{key} string, path string, value string")


def loop_merge(base, update, replaced=(), path=""):
    for k, v in update.items():
        at = f"{path}.{k}" if path else k
        if at not in replaced and isinstance(v, dict) and isinstance(base.get(k), dict):
            loop_merge(base[k], v, replaced, at)
        else:
            base[k] = json.loads(json.dumps(v))
    return base


def random_doc(rng, depth=0):
    if depth == 3 or (depth and rng.random() < 0.3):
        return rng.choice([1, "x", None, [1, 2], {}, True])
    names = ["detection", "video"] if depth == 0 else ["ocr", "templates", "a"] if depth == 1 else ["k", "m"]
    return {n: random_doc(rng, depth + 1) for n in names if rng.random() < 0.7}


def test_layers_match_the_recursive_merge(spark):
    rng = random.Random(9)
    games = [f"g{i}" for i in range(150)]
    dflt, own, over = ({g: random_doc(rng) for g in games} for _ in range(3))
    gdf = spark.createDataFrame([(g, g) for g in games], "game string, base string")
    defaults = kv(spark, dflt).withColumnRenamed("game", "base")
    got = {}
    for r in CF.resolve(gdf, defaults, kv(spark, own), kv(spark, over)).collect():
        got.setdefault(r.game, {})[r.path] = r.value
    for g in games:
        doc = loop_merge(json.loads(json.dumps(dflt[g])), own[g], CF.REPLACED_SECTIONS)
        doc = loop_merge(doc, over[g])
        assert got.get(g, {}) == dict(leaves(doc)), (dflt[g], own[g], over[g])


def test_game_replaces_sections_and_override_merges(spark):
    gdf = spark.createDataFrame([("g", "d")], "game string, base string")
    d = kv(spark, {"d": {"detection": {"ocr": {"enabled": False, "lang": "ch"}, "confidence_threshold": 0.5}}}).withColumnRenamed("game", "base")
    out = CF.resolve(gdf, d, kv(spark, {"g": {"detection": {"ocr": {"enabled": True}}}}), kv(spark, {"g": {"detection": {"ocr": {"lang": "en"}}}}))
    assert {r.path: r.value for r in out.collect()} == {"detection.ocr.enabled": "true", "detection.ocr.lang": '"en"', "detection.confidence_threshold": "0.5"}
    assert [r.game for r in CF.unknown_games(gdf, kv(spark, {"x": {"a": 1}})).collect()] == ["g"]


def test_typed_defaults_and_coercions(spark):
    docs = {
        "plain": {"video": {"fps": 60}},
        "odd": {
            "detection": {
                "killfeed_roi": [0.1, "0.2", 0.3, 0.4],
                "confidence_threshold": "high",
                "ocr": {"enabled": "yes", "threshold": 0.6, "keywords": []},
                "prefilter": {"enabled": "off"},
                "weights": {"yolo": "0.7"},
            },
            "highlights": {"pre_kill_time": 2.5},
        },
    }
    out = {r.game: r for r in CF.typed(kv(spark, docs)).collect()}
    p, o = out["plain"], out["odd"]
    assert (p.confidence_threshold, p.similarity_threshold, p.prefilter_enabled, p.color_threshold) == (0.5, 0.8, True, 0.01)
    assert (p.keywords, p.frame_interval_ms, p.chunk_size, p.batch_size) == (["击杀", "KILL"], 1000, 256, 16)
    assert (o.killfeed_roi, o.confidence_threshold, o.ocr_enabled) == ([0.1, 0.2, 0.3, 0.4], 0.5, True)
    assert (o.similarity_threshold, o.keywords, o.prefilter_enabled, o.weight_yolo, o.pre_kill_ms) == (0.6, [], False, 0.7, 2500)


OK = {"enabled": True, "keywords": []}
RULE = {"name": "a", "enabled": True, "require": ["ocr"]}


@pytest.fixture(scope="module")
def problems(spark):
    cases = {name: doc for name, doc, _ in CASES}
    out = {name: [] for name in cases}
    for r in CF.violations(kv(spark, cases)).collect():
        out[r.game].append(r.path)
    return out


CASES = [
    ("fine", {"config_version": 1, "detection": {"ocr": OK, "killfeed_roi": [0, 0, 1, 1], "rules": [RULE], "weights": {"ocr": 1}}}, []),
    ("null version", {"config_version": None}, []),
    ("version", {"config_version": 2}, ["config_version"]),
    ("mode", {"video": {"frame_extraction_mode": "fast"}}, ["video.frame_extraction_mode"]),
    ("pad", {"highlights": {"pre_kill_time": "3"}}, ["highlights.pre_kill_time"]),
    ("volume", {"highlights": {"game_volume": 1.01}}, ["highlights.game_volume"]),
    ("roi size", {"detection": {"killfeed_roi": [0, 0, 1]}}, ["detection.killfeed_roi"]),
    ("roi empty", {"detection": {"templates": {"t": {"roi": [0, 0, 0, 1]}}}}, ["detection.templates.t.roi"]),
    ("roi words", {"detection": {"killfeed_roi": ["a", 0, 1, 1]}}, ["detection.killfeed_roi"]),
    ("hue", {"detection": {"colors": {"c": {"hsv_upper": [181, 0, 0]}}}}, ["detection.colors.c.hsv_upper"]),
    ("hue edge", {"detection": {"colors": {"c": {"hsv_upper": [180, 255, 255]}}}}, []),
    ("color scalar", {"detection": {"colors": {"c": 3}}}, ["detection.colors.c"]),
    ("ocr absent", {"detection": {"ocr": {"lang": "en"}}}, ["detection.ocr.enabled", "detection.ocr.keywords"]),
    ("ocr similarity", {"detection": {"ocr": {**OK, "similarity_threshold": 2}}}, ["detection.ocr.similarity_threshold"]),
    ("weights", {"detection": {"weights": {"ocr": 0, "yolo": -1}}}, ["detection.weights", "detection.weights.yolo"]),
    ("rules scalar", {"detection": {"rules": 3}}, ["detection.rules"]),
    ("rule text", {"detection": {"rules": ["x"]}}, ["detection.rules[0]"]),
    ("rule twice", {"detection": {"rules": [RULE, RULE]}}, ["detection.rules"]),
    ("rule name", {"detection": {"rules": [{**RULE, "name": " "}]}}, ["detection.rules[0].name"]),
    ("rule enabled", {"detection": {"rules": [{**RULE, "enabled": "yes"}]}}, ["detection.rules[0].enabled"]),
    ("rule empty", {"detection": {"rules": [{**RULE, "require": []}]}}, ["detection.rules[0].require"]),
    ("rule signal", {"detection": {"rules": [{**RULE, "require": ["speed"]}]}}, ["detection.rules[0].require"]),
    ("override list", {"detection": {"rules": [{**RULE, "detection_overrides": [1]}]}}, ["detection.rules[0].detection_overrides"]),
    ("override roi", {"detection": {"rules": [{**RULE, "detection_overrides": {"killfeed_roi": [2, 0, 1, 1]}}]}}, ["detection.rules[0].detection_overrides.killfeed_roi"]),
    ("override ocr", {"detection": {"rules": [{**RULE, "detection_overrides": {"ocr": 1}}]}}, ["detection.rules[0].detection_overrides.ocr"]),
    (
        "override hsv",
        {"detection": {"rules": [{**RULE, "detection_overrides": {"colors": {"c": {"hsv_lower": [0, 300, 0]}}}}]}},
        ["detection.rules[0].detection_overrides.colors.c"],
    ),
]


@pytest.mark.parametrize("name, want", [(n, w) for n, _, w in CASES])
def test_violations(problems, name, want):
    assert sorted(problems[name]) == sorted(want)


def test_effective_config(spark):
    base = kv(spark, {"g": {"ocr": {"lang": "ch", "deep": {"x": 1, "y": 2}}, "threshold": 0.5, "list": [1]}})
    over = kv(spark, {"g": {"ocr": {"deep": {"x": 9}}, "threshold": {"low": 1}, "new": 2}}).withColumn("rule", F.lit("r"))
    out = {r.path: r.value for r in rules.effective_config(base, over).collect()}
    assert out == {"ocr.lang": '"ch"', "ocr.deep.x": "9", "threshold.low": "1", "list": "[1]", "new": "2"}


DOC = {"global": {"a": 1}, "video": {"fps": 60}, "detection": {"t": 0.5}, "ai": {"b": 1}, "highlights": {"p": 3}, "notes": {"n": 1}}


@pytest.mark.parametrize(
    "change, stage",
    [({}, None), ({"video": {"fps": 30}}, "frames"), ({"ai": {"b": 2}}, "detection"), ({"detection": {"t": 1}, "highlights": {"p": 1}}, "detection"),
     ({"highlights": {"p": 4}}, "clips"), ({"global": {"a": 2}}, "audio"), ({"notes": {"n": 2}}, None)],
)
def test_earliest_stage(spark, change, stage):
    old = lineage.fingerprints(kv(spark, {"g": DOC}))
    new = lineage.fingerprints(kv(spark, {"g": {k: {**v, **change.get(k, {})} for k, v in reversed(DOC.items())}}))
    assert lineage.earliest_stage(old, new).first().stage == stage
    assert {len(r.hash) for r in new.collect()} == {16}


def test_invalidation_and_plan(spark):
    st = spark.createDataFrame([(v, s, "SUCCESS") for v in (1, 2, 3, 4) for s in runs.STAGES if not (v == 4 and s == "clips")], "video_id int, stage string, status string")
    since = spark.createDataFrame([(1, "clips"), (2, "nonsense"), (3, None)], "video_id int, stage string")
    out = {(r.video_id, r.stage): r for r in lineage.invalidate(st, since).collect()}
    assert out[1, "frames"].status == "SUCCESS" and out[1, "join"].status == "PENDING" and out[1, "join"].cleared == ["joined_video"]
    assert not any(out[v, s].invalidated for v in (2, 3, 4) for s in runs.STAGES if (v, s) in out)
    videos = spark.createDataFrame([(v,) for v in (1, 2, 3, 4, 5)], "video_id int")
    plan = {}
    for r in lineage.resume_plan(videos, st, since.filter("video_id = 1"), spark.createDataFrame([(2, "frames")], "video_id int, stage string")).orderBy("video_id", "stage_idx").collect():
        plan.setdefault(r.video_id, []).append(r.action)
    assert plan[1] == ["SKIP"] * 3 + ["RUN"] * 6 and plan[2] == ["SKIP"] + ["RUN"] * 8
    assert plan[3] == ["SKIP"] * 9 and plan[4].count("RUN") == 1 and plan[5] == ["RUN"] * 9


def test_missing_artifacts(spark):
    ck = spark.createDataFrame(
        [(1, ["f1", "f2"], "d1", ["c1", ""], "j", None, "r"), (2, [], "d2", [], "", None, None)],
        "video_id int, frames array<string>, detection_json string, clips array<string>, joined_video string, final_video string, report_path string",
    )
    st = spark.createDataFrame([(v, s, "SUCCESS" if s != "audio" else "FAILED") for v in (1, 2) for s in runs.STAGES], "video_id int, stage string, status string")
    inv = spark.createDataFrame([("f1", False), ("d1", True), ("d2", False), ("c1", False), ("j", False), ("r", False)], "path string, parses boolean")
    out = {(r.video_id, r.stage): r.missing for r in lineage.missing_artifacts(st, lineage.references(ck), inv).collect()}
    assert out == {(1, "frames"): 1, (1, "clips"): 1, (2, "frames"): 1, (2, "detection"): 1, (2, "join"): 1, (2, "report"): 1}
    first = {r.video_id: r.stage for r in lineage.first_invalid(spark.createDataFrame([(v, s, m) for (v, s), m in out.items()], "video_id int, stage string, missing int")).collect()}
    assert first == {1: "frames", 2: "frames"}


def test_history_retention(spark):
    rows = [("h", f"config_{i}", f"2024-01-{i:02d} 00:00:00") for i in range(1, 9)] + [("h", "readme", "2020-01-01 00:00:00")]
    files = spark.createDataFrame(rows, "dir string, name string, mtime string").withColumn("mtime", F.col("mtime").cast("timestamp"))
    now = F.lit("2024-01-09 00:00:00").cast("timestamp")
    out = {r.name: r.verdict for r in history.retention(files, now, keep_days=6, max_files=4).collect()}
    assert out == {**{f"config_{i}": "expired" for i in (1, 2)}, **{f"config_{i}": "excess" for i in (3, 4)}, **{f"config_{i}": "keep" for i in (5, 6, 7, 8)}}
    assert {r.verdict for r in history.retention(files, now, keep_days=0, max_files=0).collect()} == {"expired"}


def test_stage_times_and_snapshot(spark):
    ev = spark.createDataFrame(
        [(1, "frames", "RUNNING", 1.0, 1), (1, "frames", "SUCCESS", 3.5, 2), (1, "audio", "SKIPPED", 4.0, 3), (1, "clips", "RUNNING", 5.0, 4), (1, "report", "RUNNING", 6.0, 5)],
        "run_id int, stage string, status string, ts_s double, seq bigint",
    )
    times = {r.stage: (r.status, r.duration_s) for r in runs.stage_durations(ev).collect()}
    assert times == {"frames": ("SUCCESS", 2.5), "audio": ("SKIPPED", 0.0), "clips": ("RUNNING", 0.0), "report": ("RUNNING", 0.0)}
    shot = telemetry.stage_snapshot(ev).orderBy("stage_idx").collect()
    assert [r.status for r in shot] == ["pending", "success", "pending", "running", "pending", "skipped"] and {r.current_stage for r in shot} == {"clips"}
