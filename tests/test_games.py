"""Detection for all games in one pass against one pass per game, and its plan."""

import json
import random

import pytest
from pyspark.sql import functions as F

from reelspark.operators import detect, games, signals
from reelspark.operators.settings import Detection

SETTINGS = {
    "plain": {"confidence_threshold": 0.2, "ocr": {"enabled": True, "keywords": ["KILL"]}, "templates": {"t0": {"threshold": 0.6}}, "colors": {"red": {"hsv": [0, 1, 2], "tolerance": 9}}},
    "ruled": {
        "ocr": {"enabled": "yes", "keywords": ["KILL", "frag"], "threshold": 0.7},
        "templates": {"t0": {"threshold": 0.5, "roi": [0, 0, 1, 1]}, "t1": 3},
        "colors": {"red": {"lower": [1], "upper": [2]}, "blue": {"hsv": [1], "tolerance": [1, 2]}},
        "prefilter": {"enabled": True, "color_threshold": 0.02},
        "rules": [
            {"name": "sharp", "require": ["template"], "detection_overrides": {"templates": {"t1": {"threshold": 0.95}}}},
            {"name": "corner", "require": ["template", "color"], "detection_overrides": {"killfeed_roi": [0, 0, 1, 1], "prefilter": {"color_threshold": 0.03}}},
            {"name": "words", "require": ["ocr"], "detection_overrides": {"ocr": {"keywords": ["frag"], "similarity_threshold": 0.9}}},
            {"name": "fresh", "require": ["color"], "detection_overrides": {"_force_color_recompute": True, "colors": {"green": {"hsv": [1], "tolerance": 3}}}},
            {"name": "shared", "require": ["yolo", "ocr"], "detection_overrides": {"note": 1}},
            {"name": "off", "enabled": False, "require": ["yolo"]},
        ],
    },
    "strict": {"ocr": {"enabled": True, "required": True, "keywords": ["KILL"]}, "confidence_threshold": "0.3", "weights": {"ocr": 2, "yolo": "x"}, "prefilter": {"enabled": False}},
    "empty": {},
}


@pytest.fixture(scope="module")
def resolved(spark):
    docs = spark.createDataFrame([(g, json.dumps({"detection": d})) for g, d in SETTINGS.items()], "game string, doc string")
    return games.leaves(docs, ["game"], "doc").select("game", "path", "value").cache()


@pytest.fixture(scope="module")
def seen(spark):
    r = random.Random(2)
    frames, ocr, templates, colors, objects = [], [], [], [], []
    for v in range(40):
        game = [*SETTINGS, "unknown"][v % 5]
        for t in range(0, 30_000, 1000):
            frames.append((game, v, t))
            scope = lambda: r.choice(["base", "base", "rule:corner", "template:t0"])
            for i in range(r.randrange(3)):
                ocr.append((game, v, t, i, r.choice(["KILL", "kil", " Frag ", "frags", "health"]), r.choice([0.5, 80.0, 0.0]), scope()))
            for i in range(r.randrange(3)):
                templates.append((game, v, t, r.choice(["t0", "t1", "t2"]), r.random(), scope()))
            for i in range(r.randrange(3)):
                colors.append((game, v, t, r.choice(["red", "blue", "green"]), r.random() / 15, scope()))
            for i in range(r.randrange(2)):
                objects.append((game, v, t, r.choice(["kill", "person"]), r.random()))
    make = lambda rows, more: spark.createDataFrame(rows, f"game string, video_id bigint, ts_ms bigint{more}").cache()
    return make(frames, ""), signals.Observations(
        ocr=make(ocr, ", det_idx int, text string, confidence double, roi_id string"),
        templates=make(templates, ", template string, score double, roi_id string"),
        colors=make(colors, ", color string, pct double, roi_id string"),
        objects=make(objects, ", name string, conf double"),
    )


def rows(events):
    return sorted((r.game, r.video_id, r.ts_ms, round(r.confidence, 9), r.matched_rule, tuple(round(x, 9) for x in r.signals)) for r in events.collect())


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("travels", [True, False])
def test_all_games_at_once_as_each_alone(seen, resolved, strict, travels):
    frames, obs = seen
    table = games.settings(resolved)
    every = detect.detect_events_by_game(frames, obs, games.Games(table.table, table.positions, travels), strict_color=strict)
    want = []
    for game, raw in SETTINGS.items():
        own = lambda df: df.filter(F.col("game") == game)  # noqa: E731, B023
        part = signals.Observations(own(obs.ocr), own(obs.templates), own(obs.colors), own(obs.objects))
        want += rows(detect.detect_events(own(frames), part, Detection.of(raw), strict_color=strict))
    got = rows(every)
    assert got == sorted(want) and {g for g, *_ in got} >= {"plain", "ruled", "strict"} and table.positions == 7
    assert {m for *_, m, _ in got} >= {"sharp", "corner", "fresh"}


def test_loaded_templates_by_game(spark, seen, resolved):
    frames, obs = seen
    loaded = spark.createDataFrame([("plain", "t1"), ("ruled", "t0"), ("empty", "t2")], "game string, name string")
    got = rows(detect.detect_events_by_game(frames, obs, games.settings(resolved, loaded)))
    want = []
    for game, names in {"plain": ("t1",), "ruled": ("t0",), "strict": (), "empty": ("t2",)}.items():
        own = lambda df: df.filter(F.col("game") == game)  # noqa: E731, B023
        part = signals.Observations(own(obs.ocr), own(obs.templates), own(obs.colors), own(obs.objects))
        want += rows(detect.detect_events(own(frames), part, Detection.of(SETTINGS[game], names)))
    assert got == sorted(want)


def test_settings_rows_are_the_plain_settings(resolved):
    found = {r.game: r for r in games.settings(resolved).table.collect()}
    for game, raw in SETTINGS.items():
        cfg, row = Detection.of(raw), found[game]
        assert (row.confidence_threshold, row.ocr_enabled, row.ocr_required, row.color_threshold) == (cfg.confidence_threshold, cfg.ocr_enabled, cfg.ocr_required, cfg.color_threshold)
        assert (row.template_floor, row.templates_loaded, row.gated) == (cfg.template_floor, cfg.templates_loaded, cfg.prefilter_enabled and bool(cfg.colors))
        assert [(r.name, r.enabled, tuple(r.require), r.affects) for r in row.rules] == [(r.name, r.enabled, r.require, r.affects_signals) for r in cfg.rules]
        for spec, own in zip(row.specs, [cfg, *[cfg.effective(r) if r.enabled and r.affects_signals else cfg for r in cfg.rules]]):
            assert (spec.scope, spec.ocr_on, dict(spec.thresholds), dict(spec.scopes)) == (own.scope, own.ocr_enabled, own.templates, own.template_scopes)
            assert sorted(spec.colors) == sorted(c for c, ok in own.colors.items() if ok)
            words = row.lists[spec.list]
            assert words.threshold == own.similarity_threshold and tuple(k.keyword for k in words.keywords) == own.keywords


def test_rules_cost_no_further_pass(spark, tmp_path):
    (spark.range(50).select(F.col("id").alias("video_id"), F.col("id").alias("ts_ms"), F.lit("t0").alias("template"), F.lit(0.9).alias("score"), F.lit("red").alias("color"),
                            F.lit(0.5).alias("pct"), F.lit("kill").alias("name"), F.lit(0.9).alias("conf"), F.lit(0).alias("det_idx"), F.lit("KILL").alias("text"),
                            F.lit(0.9).alias("confidence")).write.parquet(str(tmp_path / "o")))
    o = spark.read.parquet(str(tmp_path / "o"))
    obs = signals.Observations(
        o.select("video_id", "ts_ms", "det_idx", "text", "confidence"), o.select("video_id", "ts_ms", "template", "score"), o.select("video_id", "ts_ms", "color", "pct"), o.select("video_id", "ts_ms", "name", "conf")
    )
    shapes = set()
    for n in (1, 10):
        rule = [{"name": f"r{i}", "require": ["template"], "detection_overrides": {"templates": {"t0": {"threshold": 0.1 + i / 20}}}} for i in range(n)]
        cfg = Detection.of({**SETTINGS["plain"], "rules": rule})
        plan = detect.detect_events(o.select("video_id", "ts_ms"), obs, cfg)._jdf.queryExecution().executedPlan().toString()
        shapes.add((plan.count("FileScan"), plan.count("Exchange"), plan.count("Join")))
    # frames, template scores, colours, objects, and texts twice: distinct ones and all
    assert len(shapes) == 1 and next(iter(shapes))[0] <= 6


def test_constraints_scan_little(spark):
    from reelspark.plans.catalog import QUERIES

    plan = QUERIES["config_violations"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 12


def test_bucketed_inventory_is_not_shuffled_again(spark):
    from reelspark.plans.catalog import QUERIES

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES["resume_from_checkpoints"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.splitlines()
    at = next(i for i, line in enumerate(lines) if "inventory_" in line)
    depth = len(lines[at]) - len(lines[at].lstrip(" :+-"))
    above = []
    for line in reversed(lines[:at]):
        own = len(line) - len(line.lstrip(" :+-"))
        if own < depth:
            above.append(line)
            depth = own
    joined = next(i for i, line in enumerate(above) if "Join" in line)
    assert not any("Exchange" in line for line in above[:joined])
