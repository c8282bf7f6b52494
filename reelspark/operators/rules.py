"""OR-of-AND rules, evaluated inside each frame's row.

The rules of a game are one array column - a literal, or a column joined in from a per-game table - so no frame
meets a rule through a join and nothing shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.functions import fusion
from reelspark.operators.settings import AFFECTING_OVERRIDES, Detection

RULE_TYPE = (
    "struct<rule_idx:int,name:string,enabled:boolean,require:array<string>,affects:boolean,recompute_color:boolean,"
    "color_threshold:double,template_floor:double>"
)
SCOPED_TYPE = "map<int,struct<ocr:double,template:double,color:double,yolo:double,color_pct:double>>"


def rules_column(cfg: Detection) -> Column:
    """The rules of one game as array<RULE_TYPE>, each with the thresholds of its effective settings."""
    rows = []
    for idx, rule in enumerate(cfg.rules):
        own = cfg.effective(rule) if rule.affects_signals else cfg
        rows.append(
            F.struct(
                F.lit(idx).alias("rule_idx"),
                F.lit(rule.name).alias("name"),
                F.lit(rule.enabled).alias("enabled"),
                F.array(*[F.lit(s) for s in rule.require]).cast("array<string>").alias("require"),
                F.lit(rule.affects_signals).alias("affects"),
                F.lit(bool(rule.overrides.get("_force_color_recompute"))).alias("recompute_color"),
                F.lit(float(own.color_threshold)).alias("color_threshold"),
                F.lit(float(own.template_floor)).alias("template_floor"),
            )
        )
    return F.array(*rows).cast(f"array<{RULE_TYPE}>")


def affects_signals(override_keys: Column) -> Column:
    """True when an override key changes how signals are computed."""
    return F.coalesce(
        F.arrays_overlap(override_keys, F.array(*[F.lit(k) for k in AFFECTING_OVERRIDES])), F.lit(False)
    )


def missing(bools: Column, require: Column) -> Column:
    """Required signals that do not hold, in order (repeats kept)."""
    return F.filter(require, lambda s: ~F.coalesce(F.try_element_at(bools, s), F.lit(False)))


def holds(bools: Column, require: Column) -> Column:
    """Every required signal holds; an empty list is vacuously true, an unknown signal is false."""
    return F.forall(require, lambda s: F.coalesce(F.try_element_at(bools, s), F.lit(False)))


def match(bools: Column, rules: Column) -> Column:
    """First enabled rule that holds, as its struct; NULL for none."""
    return F.get(F.filter(rules, lambda r: r["enabled"] & holds(bools, r["require"])), F.lit(0))


def _rule_booleans(
    rule: Column, sig: Column, base: Column, color_pct: Column, scoped: Column, loaded, strict_color, own_pct
) -> Column:
    own = F.try_element_at(scoped, rule["rule_idx"])
    own_sig = fusion.signals(own["ocr"], own["template"], own["color"], own["yolo"])
    pct = own["color_pct"] if own_pct else color_pct
    if strict_color:
        pct = F.when(~rule["recompute_color"], pct)
    own_bools = fusion.booleans(own_sig, rule["color_threshold"], pct, rule["template_floor"], loaded)
    return F.when(rule["affects"], own_bools).otherwise(base)


def verdicts(
    sig: Column,
    color_pct: Column,
    rules: Column,
    cfg: Detection,
    scoped: Column | None = None,
    *,
    strict_color: bool = False,
    own_color_pct: bool = False,
) -> Column:
    """array<struct<rule_idx,name,require,matched,missing>> over the enabled rules.

    Rules whose overrides change signals read them from ``scoped`` (rule_idx -> signals; absent -> zeros); the
    others share the frame's. The colour boolean of an overridden rule still looks at the frame's cached
    coverage, as production has always done; ``strict_color`` opts out of that for rules that ask for a
    recompute, and ``own_color_pct`` (preview) takes the rule's own coverage throughout.
    """
    scoped = F.lit(None).cast(SCOPED_TYPE) if scoped is None else scoped
    base = fusion.booleans(sig, cfg.color_threshold, color_pct, cfg.template_floor, cfg.templates_loaded)

    def verdict(rule: Column) -> Column:
        bools = _rule_booleans(
            rule, sig, base, color_pct, scoped, cfg.templates_loaded, strict_color, own_color_pct
        )
        lacking = missing(bools, rule["require"])
        return F.struct(
            rule["rule_idx"].alias("rule_idx"),
            rule["name"].alias("name"),
            rule["require"].alias("require"),
            (F.size(lacking) == 0).alias("matched"),
            lacking.alias("missing"),
        )

    return F.transform(F.filter(rules, lambda r: r["enabled"]), verdict)


def evaluate(verdict_array: Column, rules: Column) -> Column:
    """struct<outcome, rule>: outcome NULL without rules, else whether one matched; rule = lowest matching index."""
    first = F.get(F.filter(verdict_array, lambda v: v["matched"]), F.lit(0))
    return F.when(F.size(rules) > 0, F.struct(first.isNotNull().alias("outcome"), first["name"].alias("rule")))


def explain(frames: DataFrame, verdict_array: Column) -> DataFrame:
    """Long form: one row per frame and enabled rule with ``matched`` and the ``missing`` signals."""
    return frames.select("video_id", "ts_ms", F.inline(verdict_array))


def effective_config(config_kv: DataFrame, overrides_kv: DataFrame) -> DataFrame:
    """Per-rule settings as rows.

    ``config_kv(game, path, value)`` holds a game's detection section, ``overrides_kv(game, rule, path, value)``
    the overrides, paths dotted. A section present as a mapping on both sides merges one level: an override
    replaces everything under its ``section.key``. Any other override replaces its whole section.
    """
    head = lambda n: F.substring_index("path", ".", n)
    nested = F.contains(F.col("path"), F.lit("."))
    rules = overrides_kv.select("game", "rule").distinct()
    sections = config_kv.groupBy("game", head(1).alias("section")).agg(F.bool_or(nested).alias("base_nested"))
    over = overrides_kv.withColumn("section", head(1)).join(sections, ["game", "section"], "left")
    merges = nested & F.coalesce("base_nested", F.lit(False))
    over = over.withColumn("cleared", F.when(merges, head(2)).otherwise(F.col("section")))
    cleared = over.select("game", "rule", "cleared").distinct()
    base = config_kv.join(rules, "game")
    kept = base.withColumn("by_key", head(2)).withColumn("by_section", head(1))
    kept = kept.join(
        cleared.withColumnRenamed("cleared", "by_section"), ["game", "rule", "by_section"], "left_anti"
    ).join(cleared.withColumnRenamed("cleared", "by_key"), ["game", "rule", "by_key"], "left_anti")
    columns = ["game", "rule", "path", "value"]
    return kept.select(columns).unionByName(over.select(columns))
