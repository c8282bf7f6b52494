"""Gating, scoring, rules, events and template matching over the events and embeddings tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from reelspark.functions import fusion
from reelspark.operators import config as CF
from reelspark.operators import detect as D
from reelspark.operators import games as GA
from reelspark.operators import imaging
from reelspark.operators import rules as R
from reelspark.operators import signals as S
from reelspark.operators.ordered import HOUR_MS
from reelspark.plans.inputs import KILLS, RULES, SIGNALS, frame_signals, kills, query, settings, table

ID = ["video_id", "ts_ms", "event_id"]
WIDTH = 24 * HOUR_MS


def flat_signals(df, *extra):
    return df.select(*ID, *[F.col(f"signals.{s}").alias(s) for s in ("ocr", "template", "color", "yolo")], *extra)


# --- observation tables ---------------------------------------------------------------------------------------

OBSERVED = (
    KILLS
    + """,
tm AS (SELECT video_id, ts_ms, 't' || j AS template, ((c + 37 * j) % 97) / 96.0 AS score, 'base' AS roi_id, j AS list_pos
       FROM (SELECT *, unnest(range(k % 3 + 1)) AS j FROM kills)
       UNION ALL
       SELECT video_id, ts_ms, 't0', ((c + 53) % 97) / 96.0, 'rule:corner', 0 FROM kills WHERE event_type = 'view'),
col AS (SELECT video_id, ts_ms, CASE j WHEN 0 THEN 'red' ELSE 'blue' END AS color, ((c + 13 * j) % 41) / 1000.0 AS pct
        FROM (SELECT *, unnest(range(2)) AS j FROM kills)),
obj AS (SELECT video_id, ts_ms, CASE WHEN (c + j) % 3 = 0 THEN 'kill' ELSE 'person' END AS name,
               ((c + 19 * j) % 89) / 88.0 AS conf
        FROM (SELECT *, unnest(range(k % 2 + 1)) AS j FROM kills)),
txt AS (SELECT video_id, ts_ms, c % 101 AS conf100,
               CASE c % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 8.0 / 9 WHEN 2 THEN 0.0 WHEN 3 THEN 6.0 / 7 ELSE 0.8 END AS sim
        FROM kills WHERE event_type IN ('purchase', 'signup'))"""
)


def observations(spark, sf):
    e = kills(spark, sf)
    j = F.col("j")
    each = lambda n: e.withColumn("j", F.explode(F.sequence(F.lit(0), n)))
    base = each((F.col("k") % 3).cast("int")).select(
        "video_id",
        "ts_ms",
        F.concat(F.lit("t"), j).alias("template"),
        (((F.col("c") + 37 * j) % 97) / 96.0).alias("score"),
        F.lit("base").alias("roi_id"),
        j.alias("list_pos"),
    )
    corner = e.filter(F.col("event_type") == "view").select(
        "video_id",
        "ts_ms",
        F.lit("t0").alias("template"),
        (((F.col("c") + 53) % 97) / 96.0).alias("score"),
        F.lit("rule:corner").alias("roi_id"),
        F.lit(0).alias("list_pos"),
    )
    colors = each(F.lit(1)).select(
        "video_id",
        "ts_ms",
        F.when(j == 0, "red").otherwise("blue").alias("color"),
        (((F.col("c") + 13 * j) % 41) / 1000.0).alias("pct"),
    )
    objects = each((F.col("k") % 2).cast("int")).select(
        "video_id",
        "ts_ms",
        F.when((F.col("c") + j) % 3 == 0, "kill").otherwise("person").alias("name"),
        (((F.col("c") + 19 * j) % 89) / 88.0).alias("conf"),
    )
    words = F.array(*[F.lit(w) for w in ("KILL", "KIILL", "HEALTH", " kil ", "SKILLS")])
    ocr = e.filter(F.col("event_type").isin("purchase", "signup")).select(
        "video_id",
        "ts_ms",
        F.lit(0).alias("det_idx"),
        F.get(words, (F.col("c") % 5).cast("int")).alias("text"),
        (F.col("c") % 101).cast("double").alias("confidence"),
    )
    return S.Observations(ocr=ocr, templates=base.unionByName(corner), colors=colors, objects=objects)


def frames(spark, sf):
    return kills(spark, sf).select("video_id", "ts_ms", "event_id")


THRESHOLDS = "CASE template WHEN 't0' THEN 0.8 WHEN 't1' THEN 0.7 ELSE 0.8 END"
ASSEMBLED = (
    OBSERVED
    + f""",
a_tm AS (SELECT video_id, ts_ms, max(score) AS template FROM tm WHERE roi_id = 'base' AND score >= {THRESHOLDS} GROUP BY ALL),
a_col AS (SELECT video_id, ts_ms, max(pct) AS pct FROM col GROUP BY ALL),
a_obj AS (SELECT video_id, ts_ms, max(conf) AS yolo FROM obj WHERE name = 'kill' AND conf >= 0.5 GROUP BY ALL),
a_txt AS (SELECT video_id, ts_ms, CASE WHEN conf100 > 1 THEN conf100 / 100.0 ELSE CAST(conf100 AS DOUBLE) END AS ocr
          FROM txt WHERE sim >= 0.8),
asm AS (SELECT k.video_id, k.ts_ms, k.event_id, coalesce(ocr, 0.0) AS ocr, coalesce(template, 0.0) AS template,
               least(coalesce(pct, 0.0) * 50, 1.0) AS color, coalesce(yolo, 0.0) AS yolo, coalesce(pct, 0.0) AS color_pct
        FROM kills k LEFT JOIN a_tm USING (video_id, ts_ms) LEFT JOIN a_col USING (video_id, ts_ms)
             LEFT JOIN a_obj USING (video_id, ts_ms) LEFT JOIN a_txt USING (video_id, ts_ms))"""
)


@query(
    "signal_assembly",
    f"WITH {ASSEMBLED} SELECT * FROM asm",
)
def signal_assembly(spark, sf):
    return flat_signals(S.assemble(frames(spark, sf), observations(spark, sf), settings()), "color_pct")


@query(
    "prefilter_candidates",
    f"WITH {ASSEMBLED} SELECT video_id, ts_ms, event_id, color_pct FROM asm WHERE color_pct >= 0.02",
)
def prefilter_candidates(spark, sf):
    cfg = settings(prefilter={"enabled": "yes", "color_threshold": 0.02})
    return D.candidates(frames(spark, sf), observations(spark, sf).colors, cfg)


CONF = "(ocr * (0.4 / 1.0) + template * (0.3 / 1.0) + color * (0.2 / 1.0) + yolo * (0.1 / 1.0))"


@query(
    "prefilter_selectivity",
    f"""WITH {SIGNALS} SELECT event_id // 256 AS batch, count(*) AS total,
    count(*) FILTER (WHERE color_pct >= 0.01) AS candidates,
    count(*) FILTER (WHERE color_pct >= 0.01 AND {CONF} >= 0.5) AS detected FROM sig GROUP BY 1""",
)
def prefilter_selectivity(spark, sf):
    decided = D.decide(frame_signals(spark, sf), settings())
    batched = decided.withColumn("batch", F.floor(F.col("event_id") / 256).cast("bigint"))
    return D.batch_counters(batched, "batch", 0.01)


@query(
    "weighted_confidence",
    f"""WITH {SIGNALS} SELECT video_id, ts_ms, event_id, round({CONF}, 6) AS all_active,
    round(CASE WHEN k % 10 = 0 THEN 0.0 ELSE (template * 0.3 + color * 0.2 + yolo * 0.1) / 0.6 END, 6) AS no_ocr,
    round((color * 0.2 + yolo * 0.1) / 0.3, 6) AS color_and_object FROM sig""",
)
def weighted_confidence(spark, sf):
    cfg = settings()
    w, sig = cfg.weights, F.col("signals")
    # weights may be columns too: here all of them are zero for a tenth of the rows
    zeroed = {k: F.when(F.col("k") % 10 == 0, 0.0).otherwise(v) for k, v in w.items()}
    return frame_signals(spark, sf).select(
        *ID,
        F.round(fusion.weighted_confidence(sig, w), 6).alias("all_active"),
        F.round(fusion.weighted_confidence(sig, zeroed, ocr_active=False), 6).alias("no_ocr"),
        F.round(fusion.weighted_confidence(sig, w, False, False), 6).alias("color_and_object"),
    )


@query(
    "weighted_events",
    f"""WITH {SIGNALS} SELECT video_id, ts_ms, event_id, 'weighted' AS mode, round({CONF}, 6) AS confidence
    FROM sig WHERE color_pct >= 0.01 AND {CONF} >= 0.5""",
)
def weighted_events(spark, sf):
    cfg = settings()
    gated = frame_signals(spark, sf).filter(D.gate(F.col("color_pct"), cfg.color_threshold))
    return D.decide(gated, cfg).filter("is_event").select(*ID, "mode", F.round("confidence", 6).alias("confidence"))


@query(
    "score_explain",
    f"""WITH {SIGNALS}, s AS (SELECT *, {CONF} AS conf FROM sig),
    p AS (SELECT *, unnest(['ocr', 'template', 'color', 'yolo']) AS name, unnest([ocr, template, color, yolo]) AS v,
                 unnest([0.4, 0.3, 0.2, 0.1]) AS weight FROM s)
    SELECT video_id, ts_ms, event_id, name, CAST(v AS DOUBLE) AS value, CAST(weight AS DOUBLE) AS weight,
      round(CAST(v AS DOUBLE) * CAST(weight AS DOUBLE), 6) AS contribution, conf >= 0.5 AS accepted, round(0.5 - conf, 6) AS gap,
      CASE WHEN conf >= 0.5 THEN '' ELSE array_to_string(list_filter([
        CASE WHEN ocr = 0 THEN 'ocr_no_match' END, CASE WHEN template < 0.5 THEN 'template_low' END,
        CASE WHEN color < 0.3 THEN 'color_low' END, CASE WHEN yolo = 0 THEN 'object_none' END,
        CASE WHEN conf > 0 AND 0.5 - conf < 0.1 THEN 'near_threshold' END], lambda x: x IS NOT NULL), ',') END AS hints
    FROM p""",
)
def score_explain(spark, sf):
    cfg = settings()
    explained = frame_signals(spark, sf).withColumn(
        "x", fusion.explain_score(F.col("signals"), cfg.weights, cfg.confidence_threshold)
    )
    return explained.select(
        *ID, "x.accepted", F.round("x.gap", 6).alias("gap"), F.array_join("x.hints", ",").alias("hints"), F.inline("x.parts")
    ).withColumn("contribution", F.round("contribution", 6))


# --- rules ----------------------------------------------------------------------------------------------------

BOOLS = """, b AS (SELECT *, ocr > 0 AS b_ocr, yolo > 0 AS b_yolo, color_pct >= 0.01 AS b_color, template >= 0.7 AS b_template
    FROM sig)"""


@query(
    "rule_matches",
    f"""WITH {SIGNALS} {BOOLS} SELECT video_id, ts_ms, event_id, b_ocr, b_yolo, b_color, b_template,
    CASE WHEN b_yolo AND b_template THEN 'icon_and_object' WHEN b_ocr THEN 'text' END AS rule FROM b""",
)
def rule_matches(spark, sf):
    cfg = settings(rules=RULES)
    bools = fusion.booleans(F.col("signals"), cfg.color_threshold, F.col("color_pct"), cfg.template_floor, True)
    with_bools = frame_signals(spark, sf).withColumn("bools", bools)
    hit = R.match(F.col("bools"), R.rules_column(cfg))
    return with_bools.select(
        *ID, *[F.col("bools")[s].alias(f"b_{s}") for s in ("ocr", "yolo", "color", "template")], hit["name"].alias("rule")
    )


@query(
    "rule_explain",
    f"""WITH {SIGNALS} {BOOLS}
    SELECT video_id, ts_ms, 0 AS rule_idx, 'icon_and_object' AS name, b_yolo AND b_template AS matched,
      array_to_string(list_filter([CASE WHEN NOT b_yolo THEN 'yolo' END, CASE WHEN NOT b_template THEN 'template' END],
                                  lambda x: x IS NOT NULL), ',') AS missing FROM b
    UNION ALL SELECT video_id, ts_ms, 1, 'text', b_ocr, CASE WHEN b_ocr THEN '' ELSE 'ocr' END FROM b""",
)
def rule_explain(spark, sf):
    cfg = settings(rules=RULES)
    verdicts = R.verdicts(F.col("signals"), F.col("color_pct"), R.rules_column(cfg), cfg)
    long = R.explain(frame_signals(spark, sf), verdicts)
    return long.select("video_id", "ts_ms", "rule_idx", "name", "matched", F.array_join("missing", ",").alias("missing"))


@query(
    "rule_events",
    f"""WITH {SIGNALS} {BOOLS} SELECT video_id, ts_ms, event_id, 1.0::DOUBLE AS confidence,
    CASE WHEN b_yolo AND b_template THEN 'icon_and_object' ELSE 'text' END AS matched_rule
    FROM b WHERE color_pct >= 0.01 AND ((b_yolo AND b_template) OR b_ocr)""",
)
def rule_events(spark, sf):
    cfg = settings(rules=RULES)
    gated = frame_signals(spark, sf).filter(D.gate(F.col("color_pct"), cfg.color_threshold))
    return D.decide(gated, cfg).filter("is_event").select(*ID, "confidence", "matched_rule")


@query(
    "ocr_required_events",
    f"""WITH {SIGNALS} SELECT video_id, ts_ms, event_id,
    CASE WHEN ocr = 0 THEN 'ocr_gate' ELSE 'weighted' END AS mode,
    CASE WHEN ocr = 0 THEN 0.0 ELSE round({CONF}, 6) END AS confidence, ocr <> 0 AND {CONF} >= 0.5 AS is_event FROM sig""",
)
def ocr_required_events(spark, sf):
    cfg = settings(ocr={"enabled": True, "required": True, "keywords": ["KILL"]})
    decided = D.decide(frame_signals(spark, sf), cfg)
    return decided.select(*ID, "mode", F.round("confidence", 6).alias("confidence"), "is_event")


@query(
    "detect_events",
    f"""WITH {ASSEMBLED} SELECT video_id, ts_ms, event_id, 'kill' AS type, ocr, template, color, yolo,
    round({CONF}, 6) AS confidence FROM asm WHERE color_pct >= 0.01 AND {CONF} >= 0.5""",
)
def detect_events(spark, sf):
    """The whole chain for all videos, from observation tables, by weights."""
    events = D.detect_events(frames(spark, sf), observations(spark, sf), settings())
    return flat_signals(events, "type", F.round("confidence", 6).alias("confidence"))


OVERRIDDEN = [
    {"name": "sharp_icon", "enabled": True, "require": ["template", "color"],
     "detection_overrides": {"templates": {"t1": {"threshold": 0.95}}, "prefilter": {"color_threshold": 0.03}}},
    {"name": "corner", "enabled": True, "require": ["template"], "detection_overrides": {"killfeed_roi": [0.5, 0.0, 0.5, 0.5]}},
    {"name": "object", "enabled": True, "require": ["yolo", "ocr"], "detection_overrides": {"note": "not a signal"}},
    {"name": "never", "enabled": False, "require": ["color"]},
]


@query(
    "detect_events_overrides",
    f"""WITH {ASSEMBLED},
    sharp AS (SELECT video_id, ts_ms, max(score) AS s FROM tm WHERE roi_id = 'base'
              AND score >= CASE template WHEN 't1' THEN 0.95 ELSE 0.8 END GROUP BY ALL),
    corner AS (SELECT video_id, ts_ms, max(score) AS s FROM tm WHERE roi_id = 'rule:corner' AND score >= {THRESHOLDS} GROUP BY ALL),
    r AS (SELECT a.*, coalesce(sharp.s, 0) >= 0.8 AND color_pct >= 0.03 AS m0, coalesce(corner.s, 0) >= 0.7 AS m1,
                 yolo > 0 AND ocr > 0 AS m2
          FROM asm a LEFT JOIN sharp USING (video_id, ts_ms) LEFT JOIN corner USING (video_id, ts_ms))
    SELECT video_id, ts_ms, event_id, CASE WHEN m0 THEN 'sharp_icon' WHEN m1 THEN 'corner' ELSE 'object' END AS matched_rule,
           1.0::DOUBLE AS confidence FROM r WHERE color_pct >= 0.01 AND (m0 OR m1 OR m2)""",
)
def detect_events_overrides(spark, sf):
    """Rules with signals of their own: other thresholds, another region, and one that can share."""
    events = D.detect_events(frames(spark, sf), observations(spark, sf), settings(rules=OVERRIDDEN))
    return events.select(*ID, "matched_rule", "confidence")


SHARED = {
    "detection": {
        "confidence_threshold": 0.5,
        "weights": {"ocr": 0.4, "template": 0.3, "color": 0.2, "yolo": 0.1},
        "ocr": {"enabled": True, "keywords": ["KILL"]},
        "templates": {"t0": {"threshold": 0.8}, "t1": {"threshold": 0.7}, "t2": {"threshold": 0.8}},
        "colors": {"red": {"hsv": [0, 200, 200], "tolerance": 10}, "blue": {"hsv_lower": [100, 50, 50], "hsv_upper": [130, 255, 255]}},
        "prefilter": {"enabled": True, "color_threshold": 0.01},
    }
}
OWN = {
    "rules": {"detection": {"rules": OVERRIDDEN}},
    "loose": {"detection": {"confidence_threshold": 0.45, "weights": {"ocr": 0.2, "template": 0.5, "color": 0.2, "yolo": 0.1}, "prefilter": {"color_threshold": 0.02}}},
    "words": {"detection": {"ocr": {"enabled": "yes", "required": True, "keywords": ["KILL"], "threshold": 0.85}}},
}
GAMES = ["shared", "rules", "loose", "words"]
LOOSE = "(ocr * (0.2 / 1.0) + template * (0.5 / 1.0) + color * (0.2 / 1.0) + yolo * (0.1 / 1.0))"


def games_of(spark):
    """Settings of four games, resolved from a shared document and their own layers."""
    flat = lambda docs, key: GA.leaves(spark.createDataFrame([(k, json.dumps(d)) for k, d in docs.items()], f"{key} string, doc string"), [key], "doc")
    named = spark.createDataFrame([(g, "shared") for g in GAMES], "game string, base string")
    return GA.settings(CF.resolve(named, flat({"shared": SHARED}, "base"), flat(OWN, "game")))


@query(
    "detect_events_by_game",
    f"""WITH {ASSEMBLED},
    sharp AS (SELECT video_id, ts_ms, max(score) AS s FROM tm WHERE roi_id = 'base'
              AND score >= CASE template WHEN 't1' THEN 0.95 ELSE 0.8 END GROUP BY ALL),
    corner AS (SELECT video_id, ts_ms, max(score) AS s FROM tm WHERE roi_id = 'rule:corner' AND score >= {THRESHOLDS} GROUP BY ALL),
    strict AS (SELECT video_id, ts_ms, CASE WHEN conf100 > 1 THEN conf100 / 100.0 ELSE CAST(conf100 AS DOUBLE) END AS w
               FROM txt WHERE sim >= 0.85),
    r AS (SELECT a.* EXCLUDE (ocr), video_id % 4 AS g, CASE video_id % 4 WHEN 3 THEN coalesce(w, 0.0) ELSE ocr END AS ocr,
                 coalesce(sharp.s, 0) >= 0.8 AND color_pct >= 0.03 AS m0, coalesce(corner.s, 0) >= 0.7 AS m1, yolo > 0 AND a.ocr > 0 AS m2
          FROM asm a LEFT JOIN sharp USING (video_id, ts_ms) LEFT JOIN corner USING (video_id, ts_ms) LEFT JOIN strict USING (video_id, ts_ms))
    SELECT ['shared', 'rules', 'loose', 'words'][g + 1] AS game, video_id, ts_ms, event_id, ocr, template, color, yolo,
           CASE g WHEN 1 THEN 1.0 WHEN 2 THEN round({LOOSE}, 6) ELSE round({CONF}, 6) END::DOUBLE AS confidence,
           CASE WHEN g <> 1 THEN NULL WHEN m0 THEN 'sharp_icon' WHEN m1 THEN 'corner' ELSE 'object' END AS matched_rule
    FROM r WHERE CASE g WHEN 0 THEN color_pct >= 0.01 AND {CONF} >= 0.5 WHEN 1 THEN color_pct >= 0.01 AND (m0 OR m1 OR m2)
      WHEN 2 THEN color_pct >= 0.02 AND {LOOSE} >= 0.45 ELSE color_pct >= 0.01 AND ocr > 0 AND {CONF} >= 0.5 END""",
)
def detect_events_by_game(spark, sf):
    """Four games with settings, rules and overrides of their own, decided in one pass over every channel."""
    place = lambda df: df.withColumn("game", F.get(F.array(*[F.lit(g) for g in GAMES]), (F.col("video_id") % 4).cast("int")))
    obs = observations(spark, sf)
    tagged = S.Observations(place(obs.ocr), place(obs.templates), place(obs.colors), place(obs.objects))
    events = D.detect_events_by_game(place(frames(spark, sf)), tagged, games_of(spark))
    return flat_signals(events, "game", "matched_rule", F.round("confidence", 6).alias("confidence"))


@query(
    "preview_vs_production",
    f"""WITH {SIGNALS} {BOOLS}, d AS (SELECT *, b_color AND ((b_yolo AND b_template) OR b_ocr) AS production,
      b_color AND b_ocr AS preview FROM b)
    SELECT video_id, ts_ms, event_id, production, preview,
           CASE WHEN preview THEN 'success' ELSE 'failure' END AS status,
           CASE WHEN b_color THEN 'rule needs the object detector: icon_and_object' ELSE '' END AS warnings
    FROM d""",
)
def preview_vs_production(spark, sf):
    """Where the tuning preview and production disagree."""
    cfg = settings(rules=RULES)
    both = D.preview(D.decide(frame_signals(spark, sf), cfg).drop("mode", "confidence"), cfg)
    production = F.col("is_event") & D.gate(F.col("color_pct"), cfg.color_threshold)
    return both.select(
        *ID,
        production.alias("production"),
        F.col("is_kill").alias("preview"),
        "status",
        F.array_join("warnings", ";").alias("warnings"),
    )


@query(
    "preview_weighted",
    f"""WITH {SIGNALS}, p AS (SELECT *, (ocr * 0.4 + template * 0.3 + color * 0.2) / 0.9 AS conf FROM sig)
    SELECT video_id, ts_ms, event_id, 'weighted' AS mode, color_pct >= 0.01 AS prefilter_passed,
      CASE WHEN color_pct >= 0.01 THEN round(conf, 6) ELSE 0.0 END AS confidence,
      color_pct >= 0.01 AND conf >= 0.5 AS is_kill FROM p""",
)
def preview_weighted(spark, sf):
    out = D.preview(frame_signals(spark, sf), settings())
    return out.select(*ID, "mode", "prefilter_passed", F.round("confidence", 6).alias("confidence"), "is_kill")


@query(
    "rules_by_game",
    f"""WITH {SIGNALS} {BOOLS}, g AS (SELECT *, video_id % 3 AS game FROM b)
    SELECT video_id, ts_ms, event_id, CASE game WHEN 0 THEN CASE WHEN b_ocr THEN 'text' END
      WHEN 1 THEN CASE WHEN b_yolo AND b_color THEN 'object' END ELSE CASE WHEN b_template THEN 'icon' END END AS matched_rule
    FROM g WHERE color_pct >= 0.01 AND CASE game WHEN 0 THEN b_ocr WHEN 1 THEN b_yolo AND b_color ELSE b_template END""",
)
def rules_by_game(spark, sf):
    """Every game's own rules in one job: the rule lists are a per-game table joined by key."""
    cfg = settings(rules=RULES)
    by_game = table(spark, sf, "events").select((F.col("user_id") % 3).alias("game")).distinct().withColumns(
        {
            "name": F.when(F.col("game") == 0, "text").when(F.col("game") == 1, "object").otherwise("icon"),
            "require": F.when(F.col("game") == 0, F.array(F.lit("ocr")))
            .when(F.col("game") == 1, F.array(F.lit("yolo"), F.lit("color")))
            .otherwise(F.array(F.lit("template"))),
        }
    )
    rule = F.struct(
        F.lit(0).alias("rule_idx"), "name", F.lit(True).alias("enabled"), "require",
        F.lit(False).alias("affects"), F.lit(False).alias("recompute_color"),
        F.lit(0.01).alias("color_threshold"), F.lit(0.7).alias("template_floor"),
    )
    lists = by_game.groupBy("game").agg(F.collect_list(rule).alias("rules"))
    gated = frame_signals(spark, sf).filter("color_pct >= 0.01").withColumn("game", F.col("video_id") % 3)
    decided = D.decide(gated.join(lists, "game"), cfg, rules=F.col("rules"))
    return decided.filter("is_event").select(*ID, "matched_rule")


@query(
    "detection_summary",
    f"""WITH {SIGNALS}, ev AS (SELECT *, {CONF} AS conf FROM sig WHERE color_pct >= 0.01 AND {CONF} >= 0.5),
    f AS (SELECT video_id, count(*) AS frames FROM sig GROUP BY video_id),
    e AS (SELECT video_id, count(*) AS events, avg(conf) AS a, min(ts_ms) AS first_ts_ms, arg_min(conf, ts_ms) AS fc,
                 max(ts_ms) AS last_ts_ms, arg_max(conf, ts_ms) AS lc FROM ev GROUP BY video_id)
    SELECT video_id, frames, coalesce(events, 0) AS events, round(a, 9) AS avg_confidence, first_ts_ms,
           round(fc, 6) AS first_confidence, last_ts_ms, round(lc, 6) AS last_confidence
    FROM f LEFT JOIN e USING (video_id)""",
)
def detection_summary(spark, sf):
    decided = D.decide(frame_signals(spark, sf), settings()).filter("color_pct >= 0.01 AND is_event")
    out = D.summary(kills(spark, sf), decided)
    digits = {"avg_confidence": 9, "first_confidence": 6, "last_confidence": 6}
    return out.withColumns({c: F.round(c, n) for c, n in digits.items()})


@query(
    "detection_progress",
    f"""WITH {SIGNALS}, n AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY ts_ms, event_id) AS rn,
      color_pct >= 0.01 AND {CONF} >= 0.5 AS ev FROM sig),
    ch AS (SELECT video_id, (rn - 1) // 16 AS chunk, max(rn) AS processed, count(*) FILTER (WHERE ev) AS found
           FROM n GROUP BY ALL)
    SELECT video_id, chunk, processed, CAST(sum(processed - chunk * 16) OVER (PARTITION BY video_id) AS BIGINT) AS total,
           CAST(sum(found) OVER (PARTITION BY video_id ORDER BY chunk) AS BIGINT) AS detected FROM ch""",
)
def detection_progress(spark, sf):
    flagged = D.decide(frame_signals(spark, sf), settings()).withColumn(
        "is_event", F.col("is_event") & (F.col("color_pct") >= 0.01)
    )
    return D.progress(flagged, "ts_ms", 16, tie=["event_id"])


# --- templates and pixels -------------------------------------------------------------------------------------


@query(
    "best_template",
    f"""WITH {OBSERVED}, r AS (SELECT *, row_number() OVER (PARTITION BY video_id, ts_ms ORDER BY score DESC, list_pos) AS n
      FROM tm WHERE roi_id = 'base')
    SELECT video_id, ts_ms, CASE WHEN score > 0 THEN template END AS template, score,
      CASE WHEN score >= 0.8 THEN list_pos END AS x FROM r WHERE n = 1""",
)
def best_template(spark, sf):
    scores = observations(spark, sf).templates.filter("roi_id = 'base'").withColumn("loc", F.struct(F.col("list_pos").alias("x")))
    return S.best_template(scores, 0.8).select("video_id", "ts_ms", "template", "score", "loc.x")


@query(
    "all_templates",
    f"""WITH {OBSERVED} SELECT video_id, ts_ms, string_agg(template || '=' || CAST(round(score * 96) AS INTEGER), ',' ORDER BY template) AS found
    FROM tm WHERE roi_id = 'base' AND score >= 0.6 GROUP BY ALL""",
)
def all_templates(spark, sf):
    scores = observations(spark, sf).templates.filter("roi_id = 'base'").withColumn("loc", F.col("list_pos"))
    found = S.all_templates(scores, 0.6)
    pairs = F.transform(
        F.map_entries("matches"),
        lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"]["score"] * 96).cast("int").cast("string")),
    )
    return found.select("video_id", "ts_ms", F.array_join(F.array_sort(pairs), ",").alias("found"))


@query(
    "loaded_templates",
    """WITH src AS (SELECT 'icon_' || p_partkey % 50 AS name, 'dir/' || p_partkey AS path, 0 AS priority, p_partkey AS seq FROM part
      UNION ALL SELECT 'icon_' || s_suppkey % 20, 'cfg/' || s_suppkey, 1, s_suppkey FROM supplier),
    r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY priority DESC, seq DESC) AS n FROM src)
    SELECT name, path FROM r WHERE n = 1 AND name IN (SELECT 'icon_' || n_nationkey FROM nation)""",
)
def loaded_templates(spark, sf):
    icon = lambda key, mod: F.concat(F.lit("icon_"), F.col(key) % mod)
    folder = table(spark, sf, "part").select(
        icon("p_partkey", 50).alias("name"), F.concat(F.lit("dir/"), "p_partkey").alias("path"),
        F.lit(0).alias("priority"), F.col("p_partkey").alias("seq"),
    )
    configured = table(spark, sf, "supplier").select(
        icon("s_suppkey", 20).alias("name"), F.concat(F.lit("cfg/"), "s_suppkey").alias("path"),
        F.lit(1).alias("priority"), F.col("s_suppkey").alias("seq"),
    )
    wanted = table(spark, sf, "nation").select(F.concat(F.lit("icon_"), "n_nationkey").alias("name"))
    return S.loaded_templates(folder.unionByName(configured), wanted)


TEMPLATES = """u AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
m AS (SELECT vec_id, label, list_transform(v, lambda x: x - list_avg(v)) AS c FROM u),
n AS (SELECT vec_id, label, c, sqrt(list_sum(list_transform(c, lambda x: x * x))) AS norm FROM m),
t AS (SELECT label, arg_min(c, vec_id) AS tc, arg_min(norm, vec_id) AS tn FROM n GROUP BY label),
s AS (SELECT n.vec_id, 'label_' || t.label AS template, list_sum(list_transform(list_zip(n.c, t.tc), lambda p: p[1] * p[2])) / (n.norm * t.tn) AS score
      FROM n CROSS JOIN t)"""


@query(
    "template_correlation",
    f"WITH {TEMPLATES} SELECT vec_id, arg_max(template, score) AS template, round(max(score), 6) AS score FROM s GROUP BY vec_id",
)
def template_correlation(spark, sf):
    vectors = table(spark, sf, "embeddings")
    templates = vectors.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vec")).select(
        F.concat(F.lit("label_"), "label").alias("name"), "vec"
    )
    patches = vectors.select("vec_id", F.col("embedding").alias("vec"))
    best = imaging.template_correlation(patches, templates, keys=["vec_id"])
    return best.withColumn("score", F.round("score", 6))


PIXELS = """px AS (SELECT vec_id, CAST(floor(abs(CAST(embedding[p] AS DOUBLE)) * 1000) AS BIGINT) % 256 AS r,
       CAST(floor(abs(CAST(embedding[p % 64 + 1] AS DOUBLE)) * 1000) AS BIGINT) % 256 AS g,
       CAST(floor(abs(CAST(embedding[(p + 1) % 64 + 1] AS DOUBLE)) * 1000) AS BIGINT) % 256 AS b
       FROM (SELECT *, unnest(range(1, 65)) AS p FROM embeddings))"""
HSV = """hsv AS (SELECT *, greatest(r, g, b) AS v, greatest(r, g, b) - least(r, g, b) AS d FROM px),
hs AS (SELECT *, CASE WHEN d = 0 THEN 0.0::DOUBLE WHEN v = r THEN (g - b) / d::DOUBLE WHEN v = g THEN 2 + (b - r) / d::DOUBLE
      ELSE 4 + (r - g) / d::DOUBLE END * 30 AS half FROM hsv),
hh AS (SELECT *, CAST(floor(CASE WHEN half < 0 THEN half + 180 ELSE half END + 0.5) AS BIGINT) % 180 AS h,
      CASE WHEN v = 0 THEN 0 ELSE CAST(floor(d * 255.0::DOUBLE / v + 0.5) AS BIGINT) END AS s FROM hs)"""
BOUNDS = {"warm": ([0, 60, 60], [40, 255, 255]), "cool": ([90, 60, 60], [140, 255, 255])}


def pixels(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("p"))
    level = lambda off: (F.floor(F.abs(F.get("embedding", (F.col("p") + off) % 64).cast("double")) * 1000) % 256).cast("int")
    return e.select("vec_id", level(0).alias("r"), level(1).alias("g"), level(2).alias("b"))


@query(
    "color_coverage",
    f"""WITH {PIXELS}, {HSV} SELECT vec_id, 'warm' AS color,
      count(*) FILTER (WHERE h BETWEEN 0 AND 40 AND s >= 60 AND v >= 60) / count(*)::DOUBLE AS pct FROM hh GROUP BY vec_id
    UNION ALL SELECT vec_id, 'cool', count(*) FILTER (WHERE h BETWEEN 90 AND 140 AND s >= 60 AND v >= 60) / count(*)::DOUBLE
    FROM hh GROUP BY vec_id""",
)
def color_coverage(spark, sf):
    return imaging.coverage_from_pixels(pixels(spark, sf), BOUNDS, keys=["vec_id"])


@query(
    "color_coverage_packed",
    f"""WITH {PIXELS}, {HSV} SELECT vec_id AS image_id, 'warm' AS color,
      count(*) FILTER (WHERE h BETWEEN 0 AND 40 AND s >= 60 AND v >= 60) / count(*)::DOUBLE AS pct FROM hh GROUP BY vec_id
    UNION ALL SELECT vec_id, 'cool', count(*) FILTER (WHERE h BETWEEN 90 AND 140 AND s >= 60 AND v >= 60) / count(*)::DOUBLE
    FROM hh GROUP BY vec_id""",
)
def color_coverage_packed(spark, sf):
    """The same from packed 8x8 images through the Arrow kernel."""
    at = lambda p: F.substring(F.lpad(F.hex(F.floor(F.abs(p.cast("double")) * 1000) % 256), 2, "0"), 1, 2)
    e = F.col("embedding")
    item = lambda i, off: at(F.get(e, (i + off) % 64))
    packed = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.concat(item(i, 2), item(i, 1), item(i, 0))), "")
    images = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("image_id"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.unhex(packed).alias("bgr")
    )
    return imaging.color_coverage(images, BOUNDS)


@query(
    "weakest_color",
    f"""WITH {OBSERVED} SELECT video_id, ts_ms, arg_min(color, (pct, color)) AS color, min(pct) AS pct, min(pct) < 0.01 AS weak
    FROM col GROUP BY ALL""",
)
def weakest_color(spark, sf):
    return imaging.weakest_color(observations(spark, sf).colors)
