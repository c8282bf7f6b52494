"""From frames and observations to events: gate, decide, count.

One event per positive frame; nothing is de-duplicated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.functions import fusion
from reelspark.operators import games as G
from reelspark.operators import positions as P
from reelspark.operators import rules as R
from reelspark.operators import signals as S
from reelspark.operators.ordered import BUCKET_ROWS, COUNT_WIDTH, Run, running
from reelspark.operators.settings import Detection


def gate(color_pct: Column, threshold) -> Column:
    """Frames without a coverage (gate off) pass; others need the threshold."""
    return color_pct.isNull() | (color_pct >= threshold)


def prefilter(frames: DataFrame, colors: DataFrame | None, cfg: Detection) -> DataFrame:
    """Frames with ``color_pct`` and ``passed``; off or without colours everything passes with NULL."""
    if not cfg.prefilter_enabled or not cfg.colors or colors is None:
        return frames.withColumns({"color_pct": F.lit(None).cast("double"), "passed": F.lit(True)})
    best = S.color_hits(colors, cfg).groupBy(*S.KEYS).agg(F.max("pct").alias("color_pct"))
    pct = F.coalesce("color_pct", F.lit(0.0))
    return frames.join(best, list(S.KEYS), "left").withColumns(
        {"color_pct": pct, "passed": gate(pct, cfg.color_threshold)}
    )


def candidates(frames: DataFrame, colors: DataFrame | None, cfg: Detection) -> DataFrame:
    """Frames worth the expensive models; apply before any Python stage."""
    return prefilter(frames, colors, cfg).filter("passed").drop("passed")


def decide(
    frames: DataFrame,
    cfg: Detection,
    *,
    scoped: Column | None = None,
    rules: Column | None = None,
    strict_color: bool = False,
) -> DataFrame:
    """Add mode, confidence, matched_rule and is_event to frames with ``signals`` and ``color_pct``.

    Required OCR without a hit is no event. With rules the confidence is exactly 1 or 0; without, it is the
    weighted score against the threshold. ``rules`` may be a joined-in column for many games at once.
    Row-local, so it serves batch and streams alike.
    """
    rules = R.rules_column(cfg) if rules is None else rules
    sig, pct = F.col("signals"), F.col("color_pct")
    outcome = R.evaluate(R.verdicts(sig, pct, rules, cfg, scoped, strict_color=strict_color), rules)
    score = fusion.weighted_confidence(sig, cfg.weights, cfg.ocr_enabled, cfg.templates_loaded)
    blocked = F.lit(cfg.ocr_required) & (sig["ocr"] == 0)
    # rules with signals of their own are weighed once, not again for every column and filter that asks for the outcome
    once = outcome if scoped is None else F.explode(F.array(outcome))
    evaluated = frames.withColumns({"__outcome": once, "__score": score, "__blocked": blocked})
    by_rules = F.col("__outcome").isNotNull()
    matched = F.col("__outcome.outcome")
    confidence = (
        F.when(F.col("__blocked"), F.lit(0.0))
        .when(by_rules, F.when(matched, F.lit(1.0)).otherwise(F.lit(0.0)))
        .otherwise(F.col("__score"))
    )
    is_event = ~F.col("__blocked") & F.when(by_rules, matched).otherwise(
        F.col("__score") >= cfg.confidence_threshold
    )
    return evaluated.withColumns(
        {
            "mode": F.when(F.col("__blocked"), "ocr_gate").when(by_rules, "rules").otherwise("weighted"),
            "confidence": confidence,
            "matched_rule": F.when(~F.col("__blocked"), F.col("__outcome.rule")),
            "is_event": is_event,
        }
    ).drop("__outcome", "__score", "__blocked")


def detect_events(
    frames: DataFrame, obs: S.Observations, cfg: Detection, *, strict_color: bool = False, **kwargs
) -> DataFrame:
    """Frames and observations -> events, for all videos of one game at once; rules with signals of their own cost no further pass."""
    if any(rule.enabled and rule.affects_signals for rule in cfg.rules):
        every = P.positions_of(cfg)
        seen = P.observe(obs, P.literal(cfg), len(every), **kwargs)
        ready = P.assembled(frames, seen, R.rules_column(cfg), cfg.prefilter_enabled and bool(cfg.colors))
        scoped = F.col("scoped")
    else:
        ready, scoped = S.assemble(frames, obs, cfg, **kwargs), None
    return _events(ready.filter(gate(F.col("color_pct"), cfg.color_threshold)), frames.columns, cfg, scoped, None, strict_color)


def _events(ready: DataFrame, columns: list[str], cfg, scoped: Column | None, rules: Column | None, strict_color: bool) -> DataFrame:
    decided = decide(ready, cfg, scoped=scoped, rules=rules, strict_color=strict_color)
    return decided.filter("is_event").select(*columns, "confidence", F.lit("kill").alias("type"), "signals", "matched_rule")


def detect_events_by_game(frames: DataFrame, obs: S.Observations, games: G.Games, *, strict_color: bool = False, **kwargs) -> DataFrame:
    """Frames and observations of many games -> events, each by the settings of its own ``game``, in one pass over every channel.

    Frames and observations carry a ``game`` column; frames of games without settings have no events.
    """
    seen = P.observe(obs, games.tag, games.positions, keys=["game"], **kwargs)
    known = games.join(frames, G.DECISION)
    ready = P.assembled(known, seen, F.col("rules"), F.col("gated"))
    cfg = G.Columns()
    return _events(ready.filter(gate(F.col("color_pct"), cfg.color_threshold)), frames.columns, cfg, F.col("scoped"), F.col("rules"), strict_color)


def preview(
    frames: DataFrame, cfg: Detection, *, scoped: Column | None = None, ocr_available: bool | None = None
) -> DataFrame:
    """The tuning decision, which differs from ``decide`` on purpose.

    Object detection is off (signal and weight 0), the gate is the colour boolean whenever colours are
    configured, overridden rules use their own coverage, and rules needing the detector are warned about.
    """
    ocr_on = cfg.ocr_enabled if ocr_available is None else cfg.ocr_enabled and ocr_available
    raw = F.col("signals")
    sig = fusion.signals(raw["ocr"], raw["template"], raw["color"], 0.0)
    pct = F.coalesce("color_pct", F.lit(0.0))
    base = fusion.booleans(sig, cfg.color_threshold, pct, cfg.template_floor, bool(cfg.templates or cfg.loaded))
    rules = R.rules_column(cfg)
    verdicts = R.verdicts(sig, pct, rules, cfg, scoped, own_color_pct=True)
    no_ocr = F.lit(cfg.ocr_required) & ~F.col("__base")["ocr"]
    passed = (F.col("__base")["color"] if cfg.colors else F.lit(True)) & ~no_ocr
    score = fusion.weighted_confidence(sig, {**cfg.weights, "yolo": 0.0}, ocr_on, cfg.templates_loaded)
    use_rules = bool(cfg.rules)
    confidence = F.when(F.exists("__verdicts", lambda v: v["matched"]), 1.0).otherwise(0.0) if use_rules else score
    threshold = F.lit(cfg.confidence_threshold)
    needs_detector = F.transform(
        F.filter("__verdicts", lambda v: F.array_contains(v["require"], "yolo")),
        lambda v: F.concat(F.lit("rule needs the object detector: "), v["name"]),
    )
    out = frames.withColumns({"__base": base, "__verdicts": verdicts}).withColumns(
        {
            "prefilter_passed": passed,
            "mode": F.when(passed & F.lit(use_rules), "rules").otherwise("weighted"),
            "confidence": F.when(passed, confidence).otherwise(0.0),
            "rule_results": F.when(passed & F.lit(use_rules), F.col("__verdicts")),
            "warnings": F.concat(
                F.when(no_ocr, F.array(F.lit("required text not found"))).otherwise(F.array().cast("array<string>")),
                F.when(passed & F.lit(use_rules), needs_detector).otherwise(F.array().cast("array<string>")),
            ),
        }
    )
    is_kill = F.when(F.lit(use_rules), F.col("confidence") == 1.0).otherwise(F.col("confidence") >= threshold)
    is_kill = F.col("prefilter_passed") & is_kill
    return out.withColumns(
        {"is_kill": is_kill, "status": F.when(is_kill, "success").otherwise("failure")}
    ).drop("__base", "__verdicts")


def summary(frames: DataFrame, events: DataFrame) -> DataFrame:
    """Per video: frames, events, average confidence, first and last event."""
    counted = frames.groupBy("video_id").agg(F.count(F.lit(1)).alias("frames"))
    found = events.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("events"),
        F.avg("confidence").alias("avg_confidence"),
        F.min("ts_ms").alias("first_ts_ms"),
        F.min_by("confidence", "ts_ms").alias("first_confidence"),
        F.max("ts_ms").alias("last_ts_ms"),
        F.max_by("confidence", "ts_ms").alias("last_confidence"),
    )
    return counted.join(found, "video_id", "left").fillna(0, ["events"])


def batch_counters(decided: DataFrame, batch: str, color_threshold: float) -> DataFrame:
    """Per batch: all frames, candidates past the gate, detected events. Counts only - never mixed into timings."""
    passed = gate(F.col("color_pct"), color_threshold)
    return decided.groupBy(batch).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(passed).alias("candidates"),
        F.count_if(passed & F.col("is_event")).alias("detected"),
    )


def progress(flagged: DataFrame, order: str, chunk: int = 256, *, rows: int = BUCKET_ROWS, tie=()) -> DataFrame:
    """After each chunk of frames: processed, total, and events so far.

    ``flagged(video_id, <order>, is_event)``, one row per frame; many may share a place, so buckets are bounded by ``rows``.
    """
    ranked = running(
        flagged.select("video_id", order, *tie, "is_event"),
        ["video_id"],
        order,
        {"rn": Run("sum", F.lit(1).cast("bigint"), "through")},
        rows=rows,
        tie=tie,
    )
    chunks = (
        ranked.withColumn("chunk", F.floor((F.col("rn") - 1) / chunk).cast("bigint"))
        .groupBy("video_id", "chunk")
        .agg(F.count_if("is_event").alias("found"), F.max("rn").alias("processed"))
    )
    totals = flagged.groupBy("video_id").agg(F.count(F.lit(1)).alias("total"))
    summed = running(
        chunks, ["video_id"], "chunk", {"detected": Run("sum", F.col("found"), "through")}, width=COUNT_WIDTH
    )
    return summed.join(totals, "video_id").select("video_id", "chunk", "processed", "total", "detected")


def with_model(frames: DataFrame, make_predict: Callable, inputs: list[str], batch_size: int = 16) -> DataFrame:
    """Run a user's object detector over candidate frames in batches; the model loads once per worker.

    ``make_predict()`` returns a function from the input arrays to an array of JSON texts, one per frame:
    a list of {name, class, conf, box}. Output is the object-detection table.
    """
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import StringType

    predict = predict_batch_udf(make_predict, return_type=StringType(), batch_size=batch_size)
    schema = "array<struct<name:string,class:int,conf:double,box:array<double>>>"
    found = frames.withColumn("__found", F.from_json(predict(*[F.col(c) for c in inputs]), schema))
    return found.select(*S.KEYS, F.posexplode("__found").alias("det_idx", "d")).select(*S.KEYS, "det_idx", "d.*")


def with_text_engine(frames: DataFrame, engine_factory: Callable, payload: str) -> DataFrame:
    """Run a user's text engine over frames; it starts once per task.

    ``engine_factory()`` returns a function from one payload to a list of (text, confidence, bbox). A frame on
    which it fails yields a row with the error and no text, not a failed job.
    """
    schema = (
        "video_id {0}, ts_ms bigint, det_idx int, text string, confidence double, bbox array<array<double>>, error string"
    ).format(frames.schema["video_id"].dataType.simpleString())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = engine_factory()
        for batch in batches:
            rows = []
            for video, ts, data in zip(batch["video_id"], batch["ts_ms"], batch[payload]):
                try:
                    for i, (word, conf, bbox) in enumerate(engine(data)):
                        rows.append((video, ts, i, word, conf, bbox, None))
                except Exception as exc:  # noqa: BLE001 - one bad frame must not end the job
                    rows.append((video, ts, None, None, None, None, f"{type(exc).__name__}: {exc}"))
            out = pd.DataFrame(
                rows, columns=["video_id", "ts_ms", "det_idx", "text", "confidence", "bbox", "error"]
            )
            yield out.astype({"det_idx": "Int32"})

    return frames.select(*S.KEYS, payload).mapInPandas(run, schema)
