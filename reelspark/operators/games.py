"""Detection settings of every game as one row per game, from resolved configuration rows.

A game's row holds what a frame needs to be decided (thresholds, weights, rules) and what an observation needs to be weighed: the
settings of the game and of each rule that overrides some, as positions of one array (``operators.positions``). Rules are a JSON
list at ``detection.rules``; a rule's overrides are laid over the game's detection section by ``rules.effective_config``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.functions import parse, similarity
from reelspark.operators import config
from reelspark.operators import rules as R
from reelspark.operators.positions import LIST_TYPE, SPEC_TYPE
from reelspark.operators.settings import BASE_SCOPE, DEFAULT_TEMPLATE_THRESHOLD, SIGNALS
from reelspark.session import durable

#: Bytes of settings (as JSON) that may travel to every task; more are dealt out in ``PARTS`` copies.
TRAVEL_BYTES = 32 << 20
PARTS = 32
#: Columns that frames need; observations need ``specs`` and ``lists``.
DECISION = (
    "confidence_threshold", *[f"weight_{s}" for s in SIGNALS], "ocr_enabled", "ocr_required", "color_threshold", "template_floor", "templates_loaded", "gated", "rules",
)
RULE = "struct<name:string,enabled:string,require:array<string>,detection_overrides:string>"


@dataclass(frozen=True)
class Columns:
    """The settings of a joined row, under the names that ``detect.decide`` reads them from plain settings."""

    rules: tuple = ()

    def __getattr__(self, name: str) -> Column:
        return F.col(name)

    @property
    def weights(self) -> dict[str, Column]:
        return {s: F.col(f"weight_{s}") for s in SIGNALS}


@dataclass(frozen=True)
class Games:
    """Settings by game, the number of positions of the game with the most rules, and whether they are few enough to travel."""

    table: DataFrame
    positions: int
    travels: bool

    def join(self, df: DataFrame, wanted: Sequence[str]) -> DataFrame:
        """``df`` with the wanted settings of its game; rows of unknown games are dropped."""
        own = self.table.select("game", *wanted)
        if self.travels:
            return df.join(F.broadcast(own), "game")
        # a game may hold a third of all rows: they are dealt out to as many copies of its settings
        salted = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(PARTS)))
        copies = own.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(PARTS - 1).cast("bigint"))))
        return salted.join(copies, ["game", "__salt"]).drop("__salt")

    def tag(self, df: DataFrame, wanted: Sequence[str]) -> DataFrame:
        return self.join(df, wanted)


def _json_entries(text: Column) -> Column:
    """Entries of a JSON object as array<struct<key, value>> with JSON texts as values; NULL for anything else."""
    return F.map_entries(F.from_json(F.when(config.kind(text) == "object", text), "map<string,variant>"))


def leaves(objects: DataFrame, keys: Sequence[str], text: str, depth: int = 4) -> DataFrame:
    """(keys, path, value): the leaves of JSON objects as dotted paths and JSON texts, down to ``depth`` levels; what lies deeper,
    lists and empty objects stay whole."""
    rows = objects.select(*keys, F.lit("").alias("path"), F.col(text).alias("value"))
    for _ in range(depth):
        inner = (config.kind(F.col("value")) == "object") & (F.col("value") != "{}")
        under = F.when(F.col("path") == "", "").otherwise(F.concat("path", F.lit(".")))
        below = F.transform(_json_entries(F.col("value")), lambda e: F.struct(F.concat(under, e["key"]).alias("path"), F.to_json(e["value"]).alias("value")))  # noqa: B023
        rows = rows.select(*keys, F.inline(F.when(F.coalesce(inner, F.lit(False)), below).otherwise(F.array(F.struct("path", "value")))))
    return rows.filter(F.col("path") != "")


def rules_of(resolved: DataFrame) -> DataFrame:
    """(game, rule, name, enabled, require, overrides): the rules of every game in order, ``overrides`` as JSON text."""
    listed = resolved.filter(F.col("path") == "detection.rules").select("game", F.posexplode(F.from_json("value", f"array<{RULE}>")).alias("rule", "r"))
    return listed.filter(F.col("r").isNotNull()).select(
        "game",
        "rule",
        F.coalesce("r.name", F.lit("")).alias("name"),
        parse.as_bool(F.col("r.enabled"), True).alias("enabled"),
        F.coalesce("r.require", F.array().cast("array<string>")).alias("require"),
        F.coalesce("r.detection_overrides", F.lit("{}")).alias("overrides"),
    )


def _named(rows: DataFrame, section: str, fields: dict[str, Sequence[str]]) -> DataFrame:
    """One row per (game, entry of ``section``) with the JSON text of each field, under the first of its names that is there."""
    parts = F.split("path", r"\.")
    entries = rows.filter(F.col("path").startswith(f"detection.{section}.")).select("game", F.get(parts, F.lit(2)).alias("name"), F.get(parts, F.lit(3)).alias("field"), "value")
    at = lambda field: F.max(F.when(F.col("field") == field, F.col("value")))
    return entries.groupBy("game", "name").agg(*[F.coalesce(*[at(n) for n in names]).alias(f) for f, names in fields.items()], F.bool_or(F.col("field").isNotNull()).alias("mapping"))


def _templates(rows: DataFrame) -> DataFrame:
    """(game, templates): each configured template with its threshold and whether it has a region of its own."""
    found = _named(rows, "templates", {"threshold": ["threshold"], "roi": ["roi"]})
    entry = F.struct("name", parse.as_float(config.scalar(F.col("threshold")), DEFAULT_TEMPLATE_THRESHOLD).alias("threshold"), F.col("roi").isNotNull().alias("own_roi"))
    return found.groupBy("game").agg(F.array_sort(F.collect_list(entry)).alias("templates"))


def _colors(rows: DataFrame) -> DataFrame:
    """(game, colors): the configured colours, and those whose bounds resolve."""
    found = _named(rows, "colors", {"lower": ["hsv_lower", "lower"], "upper": ["hsv_upper", "upper"], "middle": ["hsv"], "tolerance": ["tolerance"]}).filter("mapping")
    given = lambda c: F.coalesce(~F.col(c).isin("null", "[]", "{}", '""', "0", "false"), F.lit(False))
    kind = config.kind(F.col("tolerance"))
    spread = F.col("tolerance").isNull() | (kind == "number") | ((kind == "array") & (F.size(F.from_json("tolerance", "array<string>")) == 3))
    usable = (given("lower") & given("upper")) | (given("middle") & spread)
    return found.groupBy("game").agg(F.count(F.lit(1)).alias("n_colors"), F.array_sort(F.collect_list(F.when(usable, F.col("name")))).alias("colors"))


def settings(resolved: DataFrame, loaded: DataFrame | None = None) -> Games:
    """The settings of every game in ``resolved`` (game, path, value).

    ``loaded(game, name)`` names the templates that are there; without it, all configured ones. Settings are a small dimension, so
    their row count and bytes are measured here: they travel to every task only below ``TRAVEL_BYTES``.
    """
    resolved = durable(resolved.select("game", "path", "value"))
    listed = durable(rules_of(resolved))
    base = resolved.filter(F.col("path").startswith("detection.") & (F.col("path") != "detection.rules"))
    overrides = durable(leaves(listed, ["game", "rule"], "overrides"))
    stripped = base.withColumn("path", F.substr("path", F.lit(len("detection.") + 1)))
    own = R.effective_config(stripped, overrides).withColumn("path", F.concat(F.lit("detection."), "path"))
    # a position is (game, place): 0 for the game, then its rules; games without any detection setting have a base position too
    place = lambda df, at: df.select(F.struct("game", at.cast("int").alias("place")).alias("game"), "path", "value")
    some = resolved.select("game").distinct().select("game", F.lit("detection").alias("path"), F.lit("{}").alias("value"))
    rows = durable(place(base.unionByName(some), F.lit(0)).unionByName(place(own, F.col("rule") + 1)))
    typed = config.typed(rows).join(_templates(rows), "game", "left").join(_colors(rows), "game", "left")
    typed = typed.select(F.col("game.place").alias("place"), F.col("game.game").alias("game"), *[c for c in typed.columns if c != "game"])
    if loaded is not None:
        typed = typed.join(loaded.groupBy("game").agg(F.array_sort(F.collect_set("name")).alias("loaded")), "game", "left").withColumn("loaded", F.coalesce("loaded", F.array().cast("array<string>")))
    else:
        typed = typed.withColumn("loaded", F.lit(None).cast("array<string>"))
    none = F.array().cast("array<string>")
    configured = F.coalesce("templates", F.array().cast("array<struct<name:string,threshold:double,own_roi:boolean>>"))
    usable = F.filter(configured, lambda t: F.col("loaded").isNull() | F.array_contains("loaded", t["name"]))
    pairs = lambda keep, value: F.map_from_entries(F.transform(keep, lambda t: F.struct(t["name"], value(t))))
    known = typed.select(
        "game",
        "place",
        "confidence_threshold",
        *[f"weight_{s}" for s in SIGNALS],
        "ocr_enabled",
        "ocr_required",
        "color_threshold",
        F.coalesce(F.array_min(F.transform(configured, lambda t: t["threshold"])), F.lit(DEFAULT_TEMPLATE_THRESHOLD)).alias("template_floor"),
        F.when(F.col("loaded").isNull(), F.size(configured) > 0).otherwise(F.size("loaded") > 0).alias("templates_loaded"),
        (F.col("prefilter_enabled") & (F.coalesce("n_colors", F.lit(0)) > 0)).alias("gated"),
        F.struct("similarity_threshold", "keywords").alias("list"),
        pairs(usable, lambda t: t["threshold"]).alias("thresholds"),
        pairs(F.filter(usable, lambda t: t["own_roi"]), lambda t: F.concat(F.lit("template:"), t["name"])).alias("scopes"),
        F.when(F.size(configured) == 0, F.coalesce("loaded", none)).otherwise(none).alias("others"),
        F.coalesce("colors", none).alias("colors"),
    )
    top = overrides.groupBy("game", "rule").agg(F.collect_set(F.substring_index("path", ".", 1)).alias("sections"))
    ruled = listed.drop("overrides").join(top, ["game", "rule"], "left").withColumn("place", F.col("rule") + 1)
    affects = R.affects_signals(F.coalesce("sections", none))
    forced = F.array_contains(F.coalesce("sections", none), "_force_color_recompute")
    force = overrides.filter(F.col("path") == "_force_color_recompute").select("game", "rule", config.scalar(F.col("value")).alias("force"))
    ruled = ruled.join(force, ["game", "rule"], "left").select(
        "game", "place", "rule", "name", "enabled", "require", affects.alias("affects"), (forced & parse.as_bool(F.col("force"), False)).alias("recompute"),
        F.array_contains(F.coalesce("sections", none), "killfeed_roi").alias("moved"),
    )
    per_place = known.join(ruled, ["game", "place"], "full")
    lists = F.array_distinct(F.transform("positions", lambda p: p["list"]))
    entries = F.collect_list(F.struct(*[c for c in per_place.columns if c != "game"]))
    in_order = F.array_sort(entries, lambda a, b: a["place"] - b["place"])  # maps cannot be compared
    all_ = per_place.groupBy("game").agg(in_order.alias("all"))
    game = F.get("all", F.lit(0))
    # rules without settings of their own share those of the game
    shared = F.transform(
        "all", lambda p: F.when((p["place"] == 0) | (p["affects"] & p["enabled"] & p["list"].isNotNull()), p).otherwise(game)
    )
    scope = lambda p: F.when(p["moved"], F.concat(F.lit("rule:"), p["name"])).otherwise(F.lit(BASE_SCOPE))
    spec = lambda p: F.struct(
        scope(p).alias("scope"),
        p["ocr_enabled"].alias("ocr_on"),
        (F.array_position("words", p["list"]) - 1).cast("int").alias("list"),
        p["templates_loaded"].alias("template_on"),
        p["thresholds"].alias("thresholds"),
        p["scopes"].alias("scopes"),
        p["others"].alias("others"),
        p["colors"].alias("colors"),
    )
    rule = lambda p: F.struct(
        p["rule"].cast("int").alias("rule_idx"),
        p["name"].alias("name"),
        p["enabled"].alias("enabled"),
        p["require"].alias("require"),
        p["affects"].alias("affects"),
        p["recompute"].alias("recompute_color"),
        F.when(p["affects"], F.coalesce(p["color_threshold"], game["color_threshold"])).otherwise(game["color_threshold"]).alias("color_threshold"),
        F.when(p["affects"], F.coalesce(p["template_floor"], game["template_floor"])).otherwise(game["template_floor"]).alias("template_floor"),
    )
    words = lambda w: F.struct(
        w["similarity_threshold"].alias("threshold"), F.transform(w["keywords"], lambda k, i: similarity.prepared(k, i)).alias("keywords")
    )
    done = (
        all_.withColumn("positions", shared)
        .withColumn("words", lists)
        .select(
            "game",
            *[game[c].alias(c) for c in DECISION if c != "rules"],
            F.transform(F.slice("all", 2, F.size("all")), rule).cast(f"array<{R.RULE_TYPE}>").alias("rules"),
            F.transform("positions", spec).cast(f"array<{SPEC_TYPE}>").alias("specs"),
            F.transform("words", words).cast(f"array<{LIST_TYPE}>").alias("lists"),
        )
    )
    done = durable(done)
    size = done.agg(F.coalesce(F.max(F.size("specs")), F.lit(1)).alias("n"), F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0)).alias("bytes")).first()
    return Games(done, size.n, size.bytes <= TRAVEL_BYTES)


