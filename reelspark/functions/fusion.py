"""Weighted fusion of the four signals, its explanation, and signal -> boolean conversion."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

SIGNAL_TYPE = "struct<ocr:double,template:double,color:double,yolo:double>"


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def signals(ocr=0.0, template=0.0, color=0.0, yolo=0.0) -> Column:
    """The signal struct; NULL parts count as 0."""
    parts = {"ocr": ocr, "template": template, "color": color, "yolo": yolo}
    return F.struct(*[F.coalesce(_col(v), F.lit(0.0)).cast("double").alias(k) for k, v in parts.items()])


def color_signal(color_pct: Column) -> Column:
    """Coverage fraction -> signal: fifty-fold, at most 1."""
    return F.least(color_pct * 50, F.lit(1.0))


def ocr_confidence(confidence: Column) -> Column:
    """Confidence on 0-1; percentages are scaled down."""
    return F.when(confidence > 1.0, confidence / 100.0).otherwise(confidence)


def active_weights(weights: Mapping, ocr_active, templates_active) -> dict[str, Column]:
    """Weights with inactive OCR / templates at 0; colour and object detection always count."""
    on = {"ocr": _col(ocr_active), "template": _col(templates_active), "color": F.lit(True), "yolo": F.lit(True)}
    return {k: F.when(on[k], _col(weights[k]).cast("double")).otherwise(0.0) for k in on}


def _total(active: Mapping[str, Column]) -> Column:
    return active["ocr"] + active["template"] + active["color"] + active["yolo"]


def weighted_confidence(sig: Column, weights: Mapping, ocr_active=True, templates_active=True) -> Column:
    """Mean of the active signals, weights renormalised; no weight at all -> 0."""
    active = active_weights(weights, ocr_active, templates_active)
    total = _total(active)
    score = F.lit(0.0)
    for name, weight in active.items():
        score = score + sig[name] * (weight / F.nullif(total, F.lit(0.0)))
    return F.coalesce(score, F.lit(0.0))


def explain_score(
    sig: Column, weights: Mapping, threshold, ocr_enabled=True, ocr_active=True, templates_active=True
) -> Column:
    """struct<confidence, accepted, gap, parts: array<struct<name,value,weight,contribution>>, hints: array<string>>.

    Hints are given for rejected frames only.
    """
    active = active_weights(weights, ocr_active, templates_active)
    total = F.nullif(_total(active), F.lit(0.0))
    parts = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                sig[name].alias("value"),
                F.coalesce(weight / total, F.lit(0.0)).alias("weight"),
                F.coalesce(sig[name] * (weight / total), F.lit(0.0)).alias("contribution"),
            )
            for name, weight in active.items()
        ]
    )
    score = weighted_confidence(sig, weights, ocr_active, templates_active)
    gap = _col(threshold) - score
    tips = {
        "ocr_no_match": _col(ocr_enabled) & (sig["ocr"] == 0),
        "template_low": sig["template"] < 0.5,
        "color_low": sig["color"] < 0.3,
        "object_none": sig["yolo"] == 0,
        "near_threshold": (score > 0) & (gap < 0.1),
    }
    hints = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in tips.items()]))
    accepted = score >= _col(threshold)
    return F.struct(
        score.alias("confidence"),
        accepted.alias("accepted"),
        gap.alias("gap"),
        parts.alias("parts"),
        F.when(accepted, F.array().cast("array<string>")).otherwise(hints).alias("hints"),
    )


def booleans(sig: Column, color_threshold, color_pct: Column, template_floor, templates_loaded) -> Column:
    """map<signal, boolean>.

    Colour compares the known coverage with the threshold and falls back to a positive signal; a template counts
    at or above the lowest configured threshold, and never when none is loaded.
    """
    color = F.when(color_pct.isNotNull(), color_pct >= _col(color_threshold)).otherwise(sig["color"] > 0)
    template = _col(templates_loaded) & (sig["template"] >= _col(template_floor))
    return F.create_map(
        F.lit("ocr"),
        sig["ocr"] > 0,
        F.lit("yolo"),
        sig["yolo"] > 0,
        F.lit("color"),
        color,
        F.lit("template"),
        template,
    )
