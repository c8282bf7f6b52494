"""Signals for many settings at once: the base settings of a game and those of each of its rules are positions of one array.

Every observation gets, beside it, the values it counts for at each position (NULL where it does not), and ONE aggregation
by (video, instant) takes the maximum at each position. So a channel is scanned once and shuffled once, whether there are
no rules or ten, one game or a thousand. The settings are one array column: a literal for a single game, or joined by game.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.functions import fusion
from reelspark.operators import text
from reelspark.operators.settings import DEFAULT_TEMPLATE_THRESHOLD, Detection
from reelspark.operators.signals import KEYS, Observations

#: Settings of one position. ``list`` is the place of its keywords among the game's lists; a template counts from its own
#: threshold on, or, where none is configured, at the default one if it is in ``others``.
SPEC_TYPE = (
    "struct<scope:string,ocr_on:boolean,list:int,template_on:boolean,thresholds:map<string,double>,scopes:map<string,string>,"
    "others:array<string>,colors:array<string>>"
)
KEYWORD_TYPE = "struct<kw_idx:int,keyword:string,norm:string,n:int,masks:map<string,bigint>>"
LIST_TYPE = f"struct<threshold:double,keywords:array<{KEYWORD_TYPE}>>"
_HIT_TYPE = "struct<similarity:double,rank:bigint,confidence:double>"

#: Adds columns ``specs`` (array of SPEC_TYPE) and ``lists`` (array of LIST_TYPE), or the second alone, to observations.
Tag = Callable[[DataFrame, Sequence[str]], DataFrame]


def positions_of(cfg: Detection) -> list[Detection]:
    """The base settings, then those of every rule; a rule that shares the base signals has the base settings."""
    return [cfg, *[cfg.effective(rule) if rule.enabled and rule.affects_signals else cfg for rule in cfg.rules]]


def _map(values: dict, kind: str) -> Column:
    items = [F.lit(x) for pair in values.items() for x in pair]
    return (F.create_map(*items) if items else F.from_json(F.lit("{}"), f"map<string,{kind}>")).cast(f"map<string,{kind}>")


def literal(cfg: Detection) -> Tag:
    """The settings of one game as literals in the plan."""
    every = positions_of(cfg)
    lists = list(dict.fromkeys((own.similarity_threshold, own.keywords) for own in every))
    specs = []
    for own in every:
        usable = [t for t in own.templates if own.loaded is None or t in own.loaded]
        specs.append(
            F.struct(
                F.lit(own.scope).alias("scope"),
                F.lit(own.ocr_enabled).alias("ocr_on"),
                F.lit(lists.index((own.similarity_threshold, own.keywords))).alias("list"),
                F.lit(own.templates_loaded).alias("template_on"),
                _map({t: float(own.templates[t]) for t in usable}, "double").alias("thresholds"),
                _map({t: own.template_scopes[t] for t in usable if t in own.template_scopes}, "string").alias("scopes"),
                F.array(*[F.lit(t) for t in (() if own.templates else own.loaded or ())]).cast("array<string>").alias("others"),
                F.array(*[F.lit(c) for c, known in own.colors.items() if known]).cast("array<string>").alias("colors"),
            )
        )
    words = [F.struct(F.lit(float(at)).alias("threshold"), text.keywords_column(kws).cast(f"array<{KEYWORD_TYPE}>").alias("keywords")) for at, kws in lists]
    made = {"specs": F.array(*specs).cast(f"array<{SPEC_TYPE}>"), "lists": F.array(*words).cast(f"array<{LIST_TYPE}>")}
    return lambda df, wanted: df.withColumns({name: made[name] for name in wanted})


def _at_scope(df: DataFrame, scope: Column) -> Column:
    return F.col("roi_id") == scope if "roi_id" in df.columns else F.lit(True)


def _template_values(df: DataFrame) -> Column:
    def value(s: Column) -> Column:
        configured = F.try_element_at(s["thresholds"], F.col("template"))
        other = F.array_contains(s["others"], F.col("template"))
        at = F.coalesce(configured, F.when(other, F.lit(DEFAULT_TEMPLATE_THRESHOLD)))
        scope = F.coalesce(F.try_element_at(s["scopes"], F.col("template")), s["scope"])
        return F.when(s["template_on"] & (F.col("score") >= at) & _at_scope(df, scope), F.col("score").cast("double"))

    return F.transform("specs", value)


def _color_values(df: DataFrame) -> Column:
    return F.transform("specs", lambda s: F.when(F.array_contains(s["colors"], F.col("color")) & _at_scope(df, s["scope"]), F.col("pct").cast("double")))


def _scored_texts(detections: DataFrame, tag: Tag, keys: Sequence[str]) -> DataFrame:
    """(keys, norm, sims): for each distinct text its best similarity in each keyword list, NULL below that list's threshold."""

    def best(words: Column) -> Column:
        found = text.best_keyword(F.col("norm"), words["keywords"], words["threshold"])["similarity"]
        return F.when((found >= words["threshold"]) & (found > 0), found)

    partitions = int(detections.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # by the plain columns the shuffle would merge with that of the distinct, which is coalesced into few tasks
    distinct = detections.select(*keys, "norm").distinct().repartition(partitions, F.xxhash64(*keys, "norm"))
    # through a generator, so that it is computed once
    sims = F.explode(F.array(F.transform("lists", best)))
    return tag(distinct, ["lists"]).select(*keys, "norm", sims.alias("sims")).filter(F.exists("sims", lambda s: s.isNotNull()))


def _text_values(detections: DataFrame, tag: Tag, keys: Sequence[str]) -> tuple[DataFrame, Column]:
    prepared = detections.withColumn("norm", F.lower(F.trim("text")))
    met = tag(prepared.join(_scored_texts(prepared, tag, keys), [*keys, "norm"]), ["specs"])

    def value(s: Column) -> Column:
        sim = F.get(F.col("sims"), s["list"])
        hit = F.struct(sim.alias("similarity"), (-F.col("det_idx")).cast("bigint").alias("rank"), F.col("confidence").cast("double").alias("confidence"))
        return F.when(s["ocr_on"] & sim.isNotNull() & _at_scope(detections, s["scope"]), hit)

    return met, F.transform("specs", value)


def observe(obs: Observations, tag: Tag, n: int, keys: Sequence[str] = (), label: str = "kill", min_conf: float = 0.5) -> DataFrame:
    """(video_id, ts_ms, positions): for each of the ``n`` positions struct(ocr, template, color_pct, yolo), NULL where nothing was seen.

    ``keys`` are further columns of the observations by which ``tag`` finds the settings.
    """
    parts: list[tuple[str, DataFrame, Column]] = []
    if obs.ocr is not None:
        parts.append(("ocr", *_text_values(obs.ocr, tag, keys)))
    if obs.templates is not None:
        parts.append(("template", tag(obs.templates, ["specs"]), _template_values(obs.templates)))
    if obs.colors is not None:
        parts.append(("color", tag(obs.colors, ["specs"]), _color_values(obs.colors)))
    types = {"ocr": f"array<{_HIT_TYPE}>", "template": "array<double>", "color": "array<double>", "yolo": "double"}
    united = None
    for name, df, values in parts:
        found = df.select(*KEYS, values.alias("__v")).filter(F.exists("__v", lambda v: v.isNotNull()))
        row = found.select(*KEYS, *[(F.col("__v") if c == name else F.lit(None)).cast(t).alias(c) for c, t in types.items()])
        united = row if united is None else united.unionByName(row)
    if obs.objects is not None:
        seen = obs.objects.filter((F.col("name") == label) & (F.col("conf") >= min_conf))
        row = seen.select(*KEYS, *[(F.col("conf") if c == "yolo" else F.lit(None)).cast(t).alias(c) for c, t in types.items()])
        united = row if united is None else united.unionByName(row)
    if united is None:
        raise ValueError("no observation tables given")
    best = {f"{c}{p}": F.max(F.get(c, F.lit(p))) for c in ("ocr", "template", "color") for p in range(n)}
    together = united.groupBy(*KEYS).agg(*[v.alias(k) for k, v in best.items()], F.max("yolo").alias("yolo"))
    at = lambda p: F.struct(
        fusion.ocr_confidence(F.col(f"ocr{p}.confidence")).alias("ocr"), F.col(f"template{p}").alias("template"), F.col(f"color{p}").alias("color_pct"), F.col("yolo").alias("yolo")
    )
    return together.select(*KEYS, F.array(*[at(p) for p in range(n)]).alias("positions"))


def signals_of(position: Column, color_pct: Column) -> Column:
    return fusion.signals(position["ocr"], position["template"], fusion.color_signal(color_pct), position["yolo"])


def assembled(frames: DataFrame, seen: DataFrame, rules: Column, gated) -> DataFrame:
    """Frames with ``color_pct`` (NULL where no coverage is taken), ``signals`` and ``scoped``, the signals of rules with their own.

    ``gated``: whether a coverage is taken for each frame; then the colour signal of a rule comes from it, unless the rule asks for
    a recompute.
    """
    gated = gated if isinstance(gated, Column) else F.lit(gated)
    joined = frames.join(seen, list(KEYS), "left")
    base, zero = F.get("positions", F.lit(0)), F.lit(0.0)
    cached = F.coalesce(base["color_pct"], zero)

    def own(rule: Column) -> Column:
        seen_at = F.get("positions", rule["rule_idx"] + 1)
        pct = F.when(gated & ~rule["recompute_color"], base["color_pct"]).otherwise(seen_at["color_pct"])
        value = F.struct(
            F.coalesce(seen_at["ocr"], zero).alias("ocr"),
            F.coalesce(seen_at["template"], zero).alias("template"),
            F.coalesce(fusion.color_signal(pct), zero).alias("color"),
            F.coalesce(seen_at["yolo"], zero).alias("yolo"),
            F.coalesce(seen_at["color_pct"], zero).alias("color_pct"),
        )
        return F.struct(rule["rule_idx"].alias("rule_idx"), value.alias("value"))

    overridden = F.filter(rules, lambda r: r["enabled"] & r["affects"])
    return joined.withColumns(
        {
            "color_pct": F.when(gated, cached),
            "signals": signals_of(base, cached),
            # through a generator, or every signal that a rule looks up would build the map again
            "scoped": F.explode(F.array(F.map_from_entries(F.transform(overridden, own)))),
        }
    ).drop("positions")


