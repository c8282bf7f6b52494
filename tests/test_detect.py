import json

import pytest
from pyspark.sql import functions as F

from reelspark.operators import detect as D
from reelspark.operators import rules as R
from reelspark.operators import signals as S
from reelspark.operators.settings import Detection

SIG = "signals struct<ocr:double,template:double,color:double,yolo:double>"
BASE = {
    "confidence_threshold": 0.5,
    "killfeed_roi": [0.7, 0.7, 0.2, 0.2],
    "colors": {"red": {"lower": [0, 0, 0], "upper": [9, 9, 9]}},
    "ocr": {"enabled": True, "keywords": ["KILL"], "similarity_threshold": 0.8},
    "templates": {"icon": {"threshold": 0.8}},
    "weights": {"ocr": 0.4, "template": 0.3, "color": 0.2, "yolo": 0.1},
}


def frames(spark, *signals, pct=0.5):
    rows = [(1, i * 1000, pct, s) for i, s in enumerate(signals)]
    return spark.createDataFrame(rows, f"video_id int, ts_ms bigint, color_pct double, {SIG}")


def decided(df, cfg, **kw):
    return [(r.mode, round(r.confidence, 6), r.is_event, r.matched_rule) for r in D.decide(df, cfg, **kw).orderBy("ts_ms").collect()]


def test_weighted_decisions(spark):
    df = frames(spark, (1.0, 0.9, 1.0, 0.8), (0.0, 0.0, 1.0, 0.0), (0.0, 0.9, 0.9, 0.9))
    out = decided(df, Detection.of(BASE))
    assert [o[2] for o in out] == [True, False, True]
    required = decided(df, Detection.of({**BASE, "ocr": {**BASE["ocr"], "required": True}}))
    assert [o[2] for o in required] == [True, False, False] and required[1][0] == "ocr_gate"


@pytest.mark.parametrize(
    "rules, want",
    [
        ([], ("weighted", True, None)),
        ([{"name": "a", "enabled": False, "require": []}], ("rules", False, None)),
        ([{"name": "a", "require": []}], ("rules", True, "a")),
        ([{"name": "a", "require": ["yolo"]}, {"name": "b", "require": ["ocr", "color"]}], ("rules", True, "b")),
        ([{"name": "a", "require": ["unheard"]}], ("rules", False, None)),
    ],
)
def test_three_valued_rules(spark, rules, want):
    out = decided(frames(spark, (1.0, 0.9, 1.0, 0.0)), Detection.of({**BASE, "rules": rules}))[0]
    assert (out[0], out[2], out[3]) == want
    if out[0] == "rules":
        assert out[1] == (1.0 if out[2] else 0.0)


def test_overrides_merge_one_level_and_affect():
    cfg = Detection.of({**BASE, "rules": [{"name": "r", "require": ["ocr"], "detection_overrides": {"ocr": {"keywords": ["ACE"]}, "note": 1}}]})
    own = cfg.effective(cfg.rules[0])
    assert own.keywords == ("ACE",) and own.similarity_threshold == 0.8 and own.ocr_enabled
    assert cfg.rules[0].affects_signals
    assert not Detection.of({"rules": [{"name": "r", "detection_overrides": {"note": 1}}]}).rules[0].affects_signals


def test_affects_signals_column(spark):
    df = spark.createDataFrame([(["ocr"],), (["note"],), ([],), (None,)], "k array<string>")
    assert [r[0] for r in df.select(R.affects_signals(F.col("k"))).collect()] == [True, False, False, False]


def observations(spark, base_word="KILL"):
    ocr = spark.createDataFrame(
        [(1, 0, "base", 0, base_word, 0.9), (1, 1000, "base", 0, "ACE", 95.0), (1, 2000, "rule:corner", 0, "KILL", 0.8)],
        "video_id int, ts_ms bigint, roi_id string, det_idx int, text string, confidence double",
    )
    templates = spark.createDataFrame(
        [(1, 0, "base", "icon", 0.79), (1, 1000, "base", "icon", 0.9), (1, 1000, "base", "stray", 1.0)],
        "video_id int, ts_ms bigint, roi_id string, template string, score double",
    )
    colors = spark.createDataFrame(
        [(1, t, "base", c, p) for t in (0, 1000, 2000) for c, p in (("red", 0.02), ("stray", 0.9))] + [(1, 3000, "base", "red", 0.001)],
        "video_id int, ts_ms bigint, roi_id string, color string, pct double",
    )
    objects = spark.createDataFrame([(1, 0, "kill", 0.7), (1, 0, "person", 0.9), (1, 1000, "kill", 0.49)], "video_id int, ts_ms bigint, name string, conf double")
    return S.Observations(ocr, templates, colors, objects)


@pytest.fixture
def shots(spark):
    return spark.createDataFrame([(1, t) for t in (0, 1000, 2000, 3000)], "video_id int, ts_ms bigint")


def test_assembled_signals(spark, shots):
    out = {r.ts_ms: r for r in S.assemble(shots, observations(spark), Detection.of(BASE)).collect()}
    assert tuple(out[0].signals) == (0.9, 0.0, 1.0, 0.7)  # own threshold, configured names only
    assert tuple(out[1000].signals) == (0.0, 0.9, 1.0, 0.0)  # detector floor
    assert tuple(out[2000].signals) == (0.0, 0.0, 1.0, 0.0) and out[3000].color_pct == 0.001
    off = {r.ts_ms: r for r in S.assemble(shots, observations(spark), Detection.of({**BASE, "prefilter": {"enabled": False}})).collect()}
    assert off[0].color_pct is None and off[3000].signals.color == pytest.approx(0.05)


def test_percent_confidences_scale_down(spark, shots):
    cfg = Detection.of({**BASE, "ocr": {"enabled": True, "keywords": ["ACE"]}})
    out = {r.ts_ms: r.signals.ocr for r in S.assemble(shots, observations(spark), cfg).collect()}
    assert out == {0: 0.0, 1000: 0.95, 2000: 0.0, 3000: 0.0}


def test_prefilter_and_candidates(spark, shots):
    obs = observations(spark)
    assert {r.ts_ms for r in D.candidates(shots, obs.colors, Detection.of(BASE)).collect()} == {0, 1000, 2000}
    off = D.prefilter(shots, obs.colors, Detection.of({**BASE, "prefilter": {"enabled": "no"}})).collect()
    assert all(r.passed and r.color_pct is None for r in off)
    bad = Detection.of({**BASE, "colors": {"red": {"hsv": [1, 2, 3], "tolerance": [1, 2]}}})
    assert all(r.color_pct == 0.0 and not r.passed for r in D.prefilter(shots, obs.colors, bad).collect())


def test_rule_overrides_use_their_own_signals(spark, shots):
    rules = [
        {"name": "base_text", "require": ["ocr"]},
        {"name": "ace", "require": ["ocr"], "detection_overrides": {"ocr": {"keywords": ["ACE"]}}},
        {"name": "corner", "require": ["ocr"], "detection_overrides": {"killfeed_roi": [0, 0, 0.1, 0.1]}},
    ]
    events = D.detect_events(shots, observations(spark), Detection.of({**BASE, "rules": rules}))
    assert {(r.ts_ms, r.matched_rule, r.confidence) for r in events.collect()} == {(0, "base_text", 1.0), (1000, "ace", 1.0), (2000, "corner", 1.0)}
    none = D.detect_events(shots, observations(spark, "HEALTH"), Detection.of({**BASE, "rules": rules[:1]}))
    assert none.count() == 0


def test_cached_color_quirk_and_opt_out(spark):
    rules = [{"name": "r", "require": ["color"], "detection_overrides": {"_force_color_recompute": True, "prefilter": {"color_threshold": 0.3}}}]
    cfg = Detection.of({**BASE, "rules": rules})
    df = frames(spark, (0.0, 0.0, 1.0, 0.0), pct=0.2).withColumn(
        "scoped", F.create_map(F.lit(0), F.expr("named_struct('ocr',0D,'template',0D,'color',0.9D,'yolo',0D,'color_pct',0.9D)"))
    )
    assert decided(df, cfg, scoped=F.col("scoped"))[0][2] is False  # cached 0.2 < the rule's 0.3
    assert decided(df, cfg, scoped=F.col("scoped"), strict_color=True)[0][2] is True


def test_rule_explain(spark):
    cfg = Detection.of({**BASE, "rules": [{"name": "a", "require": ["yolo", "ocr", "yolo"]}, {"name": "b", "require": ["color"]}]})
    df = frames(spark, (0.0, 0.9, 1.0, 0.0))
    verdicts = R.verdicts(F.col("signals"), F.col("color_pct"), R.rules_column(cfg), cfg)
    out = {r.name: r for r in R.explain(df, verdicts).collect()}
    assert out["a"].missing == ["yolo", "ocr", "yolo"] and not out["a"].matched and out["b"].matched


def test_preview_differs_on_purpose(spark):
    df = frames(spark, (0.0, 0.0, 1.0, 0.9))
    rules = {**BASE, "rules": [{"name": "object", "require": ["yolo"]}]}
    assert decided(df, Detection.of(rules))[0][2] is True
    shown = D.preview(df, Detection.of(rules)).first()
    assert not shown.is_kill and shown.status == "failure" and shown.mode == "rules"
    assert shown.warnings == ["rule needs the object detector: object"]
    gated = D.preview(frames(spark, (1.0, 1.0, 0.0, 0.0), pct=0.0), Detection.of({**BASE, "prefilter": {"enabled": False}})).first()
    assert not gated.prefilter_passed and gated.confidence == 0.0


def test_user_detector_and_text_engine(spark):
    df = spark.createDataFrame([(1, t, float(t)) for t in range(10)], "video_id int, ts_ms bigint, data double").repartition(3)

    def make_predict():
        import numpy as np

        return lambda data: np.array([json.dumps([{"name": "kill", "class": 0, "conf": float(d) / 10, "box": [0, 0, 1, 1]}] if d > 4 else []) for d in data])

    found = D.with_model(df, make_predict, ["data"], batch_size=4).collect()
    assert sorted((r.ts_ms, r.conf) for r in found) == [(t, t / 10) for t in range(5, 10)]

    def engine():
        def read(data):
            if data == 3:
                raise ValueError("unreadable")
            return [("KILL", 0.5, [[0.0, 0.0]])] if data > 6 else []

        return read

    out = D.with_text_engine(df, engine, "data").collect()
    assert sorted(r.ts_ms for r in out if r.text) == [7, 8, 9]
    assert [(r.ts_ms, r.error) for r in out if r.error] == [(3, "ValueError: unreadable")]
