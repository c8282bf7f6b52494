"""Per-frame signals from observation tables.

All channels of a frame are united and reduced in ONE aggregation by (video, instant), with map-side combine, so
a frame with a flood of detections costs a few partial rows and four channels cost one shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.functions import fusion
from reelspark.operators import text
from reelspark.operators.settings import DEFAULT_TEMPLATE_THRESHOLD, Detection

KEYS = ("video_id", "ts_ms")


@dataclass(frozen=True)
class Observations:
    """What was seen on the frames. Every table has (video_id, ts_ms); ``roi_id`` is optional and defaults to base.

    ocr(det_idx, text, confidence), templates(template, score), colors(color, pct), objects(name, conf).
    """

    ocr: DataFrame | None = None
    templates: DataFrame | None = None
    colors: DataFrame | None = None
    objects: DataFrame | None = None


def _scoped(df: DataFrame, scope: str) -> DataFrame:
    return df.filter(F.col("roi_id") == scope) if "roi_id" in df.columns else df


def _name_map(values: Mapping[str, float]) -> Column:
    entries = [F.lit(x) for kv in values.items() for x in (kv[0], float(kv[1]))]
    return F.create_map(*entries)


def ocr_signal(detections: DataFrame, cfg: Detection) -> DataFrame:
    """(video_id, ts_ms, ocr): confidence of the best keyword match, on 0-1."""
    matched = text.match_keywords(
        _scoped(detections, cfg.scope), text.keywords_column(cfg.keywords), cfg.similarity_threshold
    )
    return matched.select(*KEYS, fusion.ocr_confidence(F.col("confidence")).alias("ocr"))


def template_hits(scores: DataFrame, cfg: Detection) -> DataFrame:
    """Scores that count: configured and loaded, at the template's own region, at or above its own threshold.

    Without configured templates every loaded one counts, at the default threshold.
    """
    if not cfg.templates:
        seen = _scoped(scores, cfg.scope)
        if cfg.loaded is not None:
            seen = seen.filter(F.col("template").isin(list(cfg.loaded)))
        return seen.filter(F.col("score") >= DEFAULT_TEMPLATE_THRESHOLD)
    usable = [t for t in cfg.templates if cfg.loaded is None or t in cfg.loaded]
    if not usable:
        return scores.filter(F.lit(False))
    if "roi_id" in scores.columns:
        scopes = F.create_map(*[F.lit(x) for t in usable for x in (t, cfg.template_scopes.get(t, cfg.scope))])
        scores = scores.filter(F.col("roi_id") == F.try_element_at(scopes, F.col("template")))
    threshold = F.try_element_at(_name_map({t: cfg.templates[t] for t in usable}), F.col("template"))
    return scores.filter(F.col("template").isin(usable) & (F.col("score") >= threshold))


def object_hits(objects: DataFrame, label: str = "kill", min_conf: float = 0.5) -> DataFrame:
    return objects.filter((F.col("name") == label) & (F.col("conf") >= min_conf))


def color_hits(colors: DataFrame, cfg: Detection) -> DataFrame:
    """Coverage of configured colours whose bounds resolve."""
    usable = [name for name, ok in cfg.colors.items() if ok]
    seen = _scoped(colors, cfg.scope)
    return seen.filter(F.col("color").isin(usable)) if usable else seen.filter(F.lit(False))


def channels(obs: Observations, cfg: Detection, label: str = "kill", min_conf: float = 0.5) -> DataFrame:
    """(video_id, ts_ms, ocr, template, color_pct, yolo), NULL where a channel saw nothing."""
    parts: dict[str, DataFrame] = {}
    if obs.ocr is not None and cfg.ocr_enabled:
        parts["ocr"] = ocr_signal(obs.ocr, cfg)
    if obs.templates is not None and cfg.templates_loaded:
        parts["template"] = template_hits(obs.templates, cfg).withColumnRenamed("score", "template_score")
    if obs.colors is not None:
        parts["color_pct"] = color_hits(obs.colors, cfg)
    if obs.objects is not None:
        parts["yolo"] = object_hits(obs.objects, label, min_conf)
    source = {"ocr": "ocr", "template": "template_score", "color_pct": "pct", "yolo": "conf"}
    null = F.lit(None).cast("double")
    united = None
    for name, part in parts.items():
        row = part.select(
            *KEYS, *[(F.col(source[c]).cast("double") if c == name else null).alias(c) for c in source]
        )
        united = row if united is None else united.unionByName(row)
    if united is None:
        raise ValueError("no observation tables given")
    return united.groupBy(*KEYS).agg(*[F.max(c).alias(c) for c in source])


def assemble(frames: DataFrame, obs: Observations, cfg: Detection, **kwargs) -> DataFrame:
    """Frames with ``color_pct`` (NULL when no coverage was taken) and the ``signals`` struct."""
    joined = frames.join(channels(obs, cfg, **kwargs), list(KEYS), "left")
    gated = cfg.prefilter_enabled and bool(cfg.colors)
    pct = F.coalesce("color_pct", F.lit(0.0))
    return joined.withColumns(
        {
            "color_pct": pct if gated else F.lit(None).cast("double"),
            "signals": fusion.signals(F.col("ocr"), F.col("template"), fusion.color_signal(pct), F.col("yolo")),
        }
    ).drop("ocr", "template", "yolo")


def scoped_signals(obs: Observations, cfg: Detection, **kwargs) -> DataFrame | None:
    """(video_id, ts_ms, scoped): signals of every enabled rule that needs its own, keyed by rule index.

    The map holds at most one entry per configured rule.
    """
    united = None
    for idx, rule in enumerate(cfg.rules):
        if not (rule.enabled and rule.affects_signals):
            continue
        own = cfg.effective(rule)
        row = channels(obs, own, **kwargs).withColumn("rule_idx", F.lit(idx))
        # without a recompute the colour signal comes from the coverage cached for the frame
        cached = cfg.prefilter_enabled and bool(cfg.colors) and not rule.overrides.get("_force_color_recompute")
        row = row.withColumn("own_color", F.lit(not cached))
        united = row if united is None else united.unionByName(row)
    if united is None:
        return None
    base = channels(Observations(colors=obs.colors), cfg).select(*KEYS, F.col("color_pct").alias("base_pct")) if (
        obs.colors is not None
    ) else None
    if base is not None:
        united = united.join(base, list(KEYS), "left")
        pct = F.when(F.col("own_color"), F.col("color_pct")).otherwise(F.col("base_pct"))
    else:
        pct = F.col("color_pct")
    value = F.struct(
        F.coalesce("ocr", F.lit(0.0)).alias("ocr"),
        F.coalesce("template", F.lit(0.0)).alias("template"),
        F.coalesce(fusion.color_signal(pct), F.lit(0.0)).alias("color"),
        F.coalesce("yolo", F.lit(0.0)).alias("yolo"),
        F.coalesce("color_pct", F.lit(0.0)).alias("color_pct"),
    )
    entry = F.struct("rule_idx", value.alias("value"))
    return united.groupBy(*KEYS).agg(F.map_from_entries(F.collect_list(entry)).alias("scoped"))


def loaded_templates(sources: DataFrame, configured: DataFrame | None = None) -> DataFrame:
    """Templates available by name; a later source (``priority``, then ``seq``) overwrites an earlier one.

    ``sources(name, path, priority, seq)``; ``configured(name)`` restricts to configured names.
    """
    latest = sources.groupBy("name").agg(F.max_by("path", F.struct("priority", "seq")).alias("path"))
    return latest if configured is None else latest.join(configured.select("name"), "name", "left_semi")


def best_template(scores: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Best-scoring template per frame (scores must exceed 0; first in ``list_pos`` wins ties).

    The location is NULL below the threshold, the name is kept.
    """
    order = F.struct("score", (-F.col("list_pos")).alias("rank"))
    best = scores.filter(F.col("score") > 0).groupBy(*KEYS).agg(
        F.max_by(F.struct("template", "score", "loc"), order).alias("best")
    )
    frames = scores.select(*KEYS).distinct()
    score = F.coalesce("best.score", F.lit(0.0))
    return frames.join(best, list(KEYS), "left").select(
        *KEYS,
        F.col("best.template").alias("template"),
        score.alias("score"),
        F.when(score >= threshold, F.col("best.loc")).alias("loc"),
    )


def all_templates(scores: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Templates at or above the threshold per frame, as map name -> (loc, score).

    A template appears once per frame (its best score), so the map is bounded by the template count.
    """
    per_template = (
        scores.filter(F.col("score") >= threshold)
        .groupBy(*KEYS, "template")
        .agg(F.max_by(F.struct("loc", "score"), "score").alias("hit"))
    )
    return per_template.groupBy(*KEYS).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("template", "hit")))).alias("matches")
    )

