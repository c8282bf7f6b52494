"""Configuration as a dimension keyed by game.

A setting is a row (game, path, value): dotted path to a leaf, JSON text as value; lists are leaves and an empty
mapping is the leaf ``{}``. One job then resolves, checks and types the settings of every game.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspark.functions import parse, roi
from reelspark.operators.settings import DEFAULT_KEYWORDS, DEFAULT_WEIGHTS, SIGNALS
from reelspark.session import durable

#: Sections a game layer replaces wholesale, and the only known configuration version.
REPLACED_SECTIONS = ("detection.ocr", "detection.templates", "detection.colors", "detection.weights", "detection.prefilter")
CONFIG_VERSION = 1

#: Rows of layers that one task merges; a row has a handful of prefixes.
ROWS = 200_000

_KV = ["game", "path", "value"]


def _prefixes(path: Column) -> Column:
    """All prefixes of a dotted path, the path itself last."""
    n = F.length(path) - F.length(F.replace(path, F.lit("."), F.lit(""))) + 1
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.call_function("substring_index", path, F.lit("."), i))


def _replaced_section(path: Column) -> Column:
    section = F.lit(None).cast("string")
    for name in REPLACED_SECTIONS:
        section = F.when((path == name) | path.startswith(name + "."), F.lit(name)).otherwise(section)
    return section


def merge_layers(layers: DataFrame) -> DataFrame:
    """Merge rows (game, layer, replaces, path, value), later layers over earlier ones, deeply by path.

    A row clears what earlier layers put at its path, below it (a scalar over a mapping) and above it (a mapping
    over a scalar). Where ``replaces`` holds, touching a replaced section clears all of that section. An empty
    mapping over a mapping changes nothing, so it clears only a scalar and gives way to leaves that survive below.

    All layers merge at once: at each of its prefixes a row meets the others that start with it, which tell up to
    which layer they clear a subtree or a single path. Every step after the one shuffle by game stays within a game,
    and ``ROWS`` of the stored layers bound what a task expands and sorts.
    """
    path, layer, at = F.col("path"), F.col("layer"), F.col("at")
    section = F.when(F.col("replaces"), _replaced_section(path))
    rows = _by_game(layers).select(*_KV, "layer", section.alias("section"), F.explode(_prefixes(path)).alias("at"))
    is_self = at == path
    soft = (F.col("value") == "{}") & F.col("section").isNull()
    below = F.when(F.col("section").isNull(), is_self & ~soft).otherwise(at == F.col("section"))
    exact = ~is_self | (F.col("section").isNull() & soft)
    met = Window.partitionBy("game", "at")
    marked = rows.withColumns({"below": F.max(F.when(below, layer)).over(met), "exact": F.max(F.when(exact, layer)).over(met)})
    cleared = (F.col("below") > layer) | (is_self & (F.col("exact") > layer))
    # settings of no game clear nothing; with the value as a key all aggregates are of fixed width, so nothing is sorted
    alive = (
        marked.groupBy("game", "path", "layer", "value")
        .agg(F.bool_or(F.coalesce(F.col("game").isNotNull() & cleared, F.lit(False))).alias("cleared"))
        .filter(~F.col("cleared") & F.col("value").isNotNull())
    )
    # in the order of path parts what lies below a path follows it at once, and the greatest of its values is the last
    following = F.lead("path").over(Window.partitionBy("game").orderBy("parts", "value"))
    ended = alive.withColumn("parts", F.split(path, r"\.")).withColumn("following", following)
    has_below = F.coalesce(F.startswith("following", F.concat(path, F.lit("."))), F.lit(False))
    return ended.filter(~F.coalesce(F.col("following") == path, F.lit(False)) & ~((F.col("value") == "{}") & has_below)).select(*_KV)


def _by_game(layers: DataFrame) -> DataFrame:
    """``layers``, stored once and counted, in as many partitions by game as keep each at about ``ROWS`` rows."""
    stored = durable(layers)
    partitions = int(layers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored.repartition(max(partitions, math.ceil(stored.count() / ROWS)), "game")


def resolve(games: DataFrame, defaults: DataFrame, game_layer: DataFrame, override: DataFrame | None = None) -> DataFrame:
    """Settings of every game: its default document, then its own layer, then the manual override.

    ``games(game, base)`` names the default document, ``defaults(base, path, value)``; the layers are
    (game, path, value). Detection sections of the game layer replace, everything else merges deeply.
    """
    at = lambda df, layer, replaces: df.select(
        *_KV, F.lit(layer).alias("layer"), F.lit(replaces).alias("replaces")
    )
    # games are few bytes but bring a document each: read as they lie they would all expand in one task
    partitions = int(games.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = games.select("game", "base").repartition(partitions, "game").distinct()
    layers = at(spread.join(defaults, "base"), 0, False).unionByName(at(game_layer, 1, True))
    return merge_layers(layers if override is None else layers.unionByName(at(override, 2, False)))


def unknown_games(games: DataFrame, game_layer: DataFrame) -> DataFrame:
    """Games asked for that have no layer of their own - an error for the caller to raise or report."""
    return games.select("game").join(game_layer.select("game").distinct(), "game", "left_anti")


def scalar(value: Column) -> Column:
    """JSON text of a scalar -> its plain text; JSON null -> NULL."""
    return F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")


def typed(resolved: DataFrame) -> DataFrame:
    """One typed row per game, defaults and coercions applied (one pass, map-side combined)."""
    at = lambda path: F.max(F.when(F.col("path") == path, F.col("value")))
    wanted = {
        "roi": "detection.killfeed_roi",
        "confidence": "detection.confidence_threshold",
        "ocr_on": "detection.ocr.enabled",
        "ocr_req": "detection.ocr.required",
        "ocr_words": "detection.ocr.keywords",
        "ocr_sim": "detection.ocr.similarity_threshold",
        "ocr_thr": "detection.ocr.threshold",
        "pre_on": "detection.prefilter.enabled",
        "pre_thr": "detection.prefilter.color_threshold",
        "chunk": "detection.chunk_size",
        "interval": "video.frame_interval_ms",
        "mode": "video.frame_extraction_mode",
        "batch": "ai.batch_size",
        "pre": "highlights.pre_kill_time",
        "post": "highlights.post_kill_time",
        "multi": "highlights.multikill_threshold",
        **{f"w_{s}": f"detection.weights.{s}" for s in SIGNALS},
    }
    listed = {"roi", "ocr_words"}
    found = resolved.groupBy("game").agg(*[at(path).alias(name) for name, path in wanted.items()])
    # each leaf is parsed once, in a projection of its own
    rows = found.select("game", *[(F.col(n) if n in listed else scalar(F.col(n))).alias(f"__{n}") for n in wanted], F.col("ocr_sim").isNotNull().alias("__has_sim"))
    text = lambda name: F.col(f"__{name}")
    whole = lambda name, default: F.coalesce(text(name).try_cast("int"), F.lit(default))
    words = F.from_json(F.col("__ocr_words"), "array<string>")
    return rows.select(
        "game",
        roi.normalize(F.from_json("__roi", "array<string>")).alias("killfeed_roi"),
        parse.as_float(text("confidence"), 0.5).alias("confidence_threshold"),
        *[parse.as_float(text(f"w_{s}"), DEFAULT_WEIGHTS[s]).alias(f"weight_{s}") for s in SIGNALS],
        parse.as_bool(text("ocr_on"), False).alias("ocr_enabled"),
        parse.as_bool(text("ocr_req"), False).alias("ocr_required"),
        F.when(F.col("__ocr_words").isNull(), F.array(*[F.lit(k) for k in DEFAULT_KEYWORDS]))
        .otherwise(F.coalesce(words, F.array().cast("array<string>")))
        .alias("keywords"),
        # the alias counts only when the key itself is absent
        F.when(F.col("__has_sim"), parse.as_float(text("ocr_sim"), 0.8))
        .otherwise(parse.as_float(text("ocr_thr"), 0.8))
        .alias("similarity_threshold"),
        parse.as_bool(text("pre_on"), True).alias("prefilter_enabled"),
        parse.as_float(text("pre_thr"), 0.01).alias("color_threshold"),
        whole("chunk", 256).alias("chunk_size"),
        whole("interval", 1000).alias("frame_interval_ms"),
        F.coalesce(text("mode"), F.lit("bulk")).alias("frame_extraction_mode"),
        whole("batch", 16).alias("batch_size"),
        F.round(parse.as_float(text("pre"), 3.0) * 1000).cast("bigint").alias("pre_kill_ms"),
        F.round(parse.as_float(text("post"), 1.0) * 1000).cast("bigint").alias("post_kill_ms"),
        F.round(parse.as_float(text("multi"), 10.0) * 1000).cast("bigint").alias("multikill_ms"),
    )


# --- quality report -------------------------------------------------------------------------------------------


def kind(json_text: Column) -> Column:
    """Kind of a JSON text: number, string, boolean, array, object, null - or invalid."""
    head = F.substring(F.ltrim(json_text), 1, 1)
    parsed = F.try_parse_json(json_text).isNotNull()
    return (
        F.when(~F.coalesce(parsed, F.lit(False)), "invalid")
        .when(head == '"', "string")
        .when(head == "[", "array")
        .when(head == "{", "object")
        .when(head.isin("t", "f"), "boolean")
        .when(head == "n", "null")
        .otherwise("number")
    )


def _number(value: Column) -> Column:
    """The number in a JSON text; NULL when it is not a number."""
    return F.when(kind(value) == "number", value.try_cast("double"))


def _between(value: Column, low: float, high: float) -> Column:
    return F.coalesce(_number(value).between(low, high), F.lit(False))


def _numbers(value: Column) -> Column:
    """The items of a JSON list as numbers; NULL for every item of another kind, quoted numbers included."""
    return F.transform(F.from_json(value, "array<variant>"), lambda v: _number(F.to_json(v)))


def _bad_roi(value: Column) -> Column:
    items = _numbers(value)
    four = (kind(value) == "array") & (F.size(items) == 4) & F.forall(items, lambda v: v.isNotNull())
    return (
        F.when(~F.coalesce(four, F.lit(False)), "must be a list of 4 numbers")
        .when(F.exists(items, lambda v: (v < 0) | (v > 1)), "values must be between 0.0 and 1.0")
        .when((items[2] <= 0) | (items[3] <= 0), "width and height must be greater than 0")
    )


def _bad_hsv(value: Column) -> Column:
    items = _numbers(value)
    three = (kind(value) == "array") & (F.size(items) == 3) & F.forall(items, lambda v: v.isNotNull())
    return (
        F.when(~F.coalesce(three, F.lit(False)), "must be a list of 3 numbers")
        .when(~items[0].between(0, 180), "hue must be between 0 and 180")
        .when(~items[1].between(0, 255), "saturation must be between 0 and 255")
        .when(~items[2].between(0, 255), "value must be between 0 and 255")
    )


def _leaf_problem(path: Column, value: Column) -> Column:
    """Problem of a single leaf, NULL when fine."""
    is_kind = lambda k: kind(value) == k
    under = lambda prefix: path.startswith(prefix)
    volume = path.isin("highlights.game_volume", "highlights.music_volume")
    pads = path.isin("highlights.pre_kill_time", "highlights.post_kill_time")
    color = under("detection.colors.")
    hsv = color & (path.endswith(".hsv_lower") | path.endswith(".hsv_upper"))
    unit = path.isin("detection.ocr.similarity_threshold", "detection.prefilter.color_threshold")
    return (
        F.when((path == "config_version") & ~is_kind("null"), F.when(~F.coalesce(_number(value) == CONFIG_VERSION, F.lit(False)), f"must be {CONFIG_VERSION}"))
        .when(
            (path == "video.frame_extraction_mode") & ~is_kind("null"),
            F.when(~scalar(value).isin("bulk", "precise"), "must be 'bulk' or 'precise'"),
        )
        .when(pads, F.when(~F.coalesce(_number(value) >= 0, F.lit(False)), "must be a non-negative number"))
        .when(volume | unit, F.when(~_between(value, 0, 1), "must be between 0 and 1"))
        .when((path == "detection.killfeed_roi") | (under("detection.templates.") & path.endswith(".roi")), _bad_roi(value))
        .when(hsv, _bad_hsv(value))
        .when(color & (F.size(F.split(path, r"\.")) == 3) & ~is_kind("object"), F.lit("must be a dict"))
        .when(path == "detection.ocr.enabled", F.when(~is_kind("boolean"), "must be a boolean"))
        .when(path == "detection.ocr.keywords", F.when(~is_kind("array"), "must be a list"))
        .when(
            under("detection.weights."),
            F.when(~F.coalesce(_number(value) >= 0, F.lit(False)), "must be a non-negative number"),
        )
        .when(path == "detection.rules", F.when(~is_kind("array"), "must be a list"))
    )


def _rule_rows(resolved: DataFrame) -> DataFrame:
    """(game, pos, rule, fields): the JSON text of every rule and of its members."""
    lists = resolved.filter((F.col("path") == "detection.rules") & (kind(F.col("value")) == "array"))
    members = F.from_json("rule", "map<string,variant>")
    return lists.select("game", F.posexplode(F.from_json("value", "array<string>")).alias("pos", "rule")).withColumn(
        "fields", F.when(kind(F.col("rule")) == "object", F.transform_values(members, lambda _, v: F.to_json(v)))
    )


def _rule_problems(rules: DataFrame) -> DataFrame:
    """All problems inside single rules, one row each."""
    field = lambda name: F.try_element_at("fields", F.lit(name))
    is_kind = lambda name, k: F.coalesce(kind(field(name)) == k, F.lit(False))
    require = F.from_json(field("require"), "array<string>")
    overrides = F.from_json(field("detection_overrides"), "map<string,variant>")
    over = lambda name: F.to_json(F.try_element_at(overrides, F.lit(name)))
    has_over = is_kind("detection_overrides", "object")
    ocr_threshold = F.to_json(
        F.try_element_at(F.from_json(over("ocr"), "map<string,variant>"), F.lit("similarity_threshold"))
    )
    colors = F.transform_values(
        F.from_json(F.when(kind(over("colors")) == "object", over("colors")), "map<string,variant>"), lambda _, v: F.to_json(v)
    )
    bad_color = lambda c: F.when(kind(c) != "object", "must be a dict").otherwise(
        F.coalesce(
            *[
                _bad_hsv_opt(F.to_json(F.try_element_at(F.from_json(c, "map<string,variant>"), F.lit(k))))
                for k in ("hsv_lower", "hsv_upper")
            ]
        )
    )
    prefix = F.format_string("detection.rules[%d]", "pos")
    entry = lambda suffix, problem: F.struct(
        F.concat(prefix, F.lit(suffix)).alias("path"), problem.alias("problem")
    )
    isobj = F.col("fields").isNotNull()
    blank = ~is_kind("name", "string") | (F.trim(scalar(field("name"))) == "")
    checks = [
        entry("", F.when(~isobj, "must be a dict")),
        entry(".name", F.when(isobj & blank, "must be a non-empty string")),
        entry(".enabled", F.when(isobj & ~is_kind("enabled", "boolean"), "must be a boolean")),
        entry(
            ".require",
            F.when(
                isobj,
                F.when(~is_kind("require", "array"), "must be a list")
                .when(F.size(require) == 0, "must not be empty")
                .when(F.exists(require, lambda s: ~F.coalesce(s.isin(*SIGNALS), F.lit(False))), "unknown signal"),
            ),
        ),
        entry(
            ".detection_overrides",
            F.when(
                isobj & field("detection_overrides").isNotNull() & ~has_over & ~is_kind("detection_overrides", "null"),
                "must be a dict",
            ),
        ),
        entry(".detection_overrides.killfeed_roi", F.when(has_over & over("killfeed_roi").isNotNull(), _bad_roi(over("killfeed_roi")))),
        entry(".detection_overrides.ocr", F.when(has_over & over("ocr").isNotNull() & (kind(over("ocr")) != "object"), "must be a dict")),
        entry(
            ".detection_overrides.ocr.similarity_threshold",
            F.when(has_over & ocr_threshold.isNotNull() & ~_between(ocr_threshold, 0, 1), "must be between 0 and 1"),
        ),
    ]
    color_checks = F.transform(
        F.coalesce(F.map_entries(colors), F.array().cast("array<struct<key:string,value:string>>")),
        lambda e: F.struct(
            F.concat(prefix, F.lit(".detection_overrides.colors."), e["key"]).alias("path"),
            bad_color(e["value"]).alias("problem"),
        ),
    )
    found = F.filter(F.concat(F.array(*checks), color_checks), lambda c: c["problem"].isNotNull())
    return rules.select("game", F.inline(found))


def _bad_hsv_opt(value: Column) -> Column:
    return F.when(value.isNotNull(), _bad_hsv(value))


def violations(resolved: DataFrame) -> DataFrame:
    """Every broken constraint as (game, path, problem); no rows means the settings are valid.

    The constraints read the settings five times, so these are written once first.
    """
    resolved = durable(resolved.select("game", "path", "value"))
    leaves = resolved.withColumn("problem", _leaf_problem(F.col("path"), F.col("value"))).filter("problem IS NOT NULL")
    weights = (
        resolved.filter(F.col("path").startswith("detection.weights."))
        .groupBy("game")
        .agg(F.max(F.coalesce(_number(F.col("value")), F.lit(0.0))).alias("top"))
        .filter("top <= 0")
        .select(
            "game",
            F.lit("detection.weights").alias("path"),
            F.lit("must contain at least one positive value").alias("problem"),
        )
    )
    has_ocr = resolved.filter(F.col("path").startswith("detection.ocr.")).groupBy("game").agg(
        F.bool_or(F.col("path") == "detection.ocr.enabled").alias("enabled"),
        F.bool_or(F.col("path") == "detection.ocr.keywords").alias("keywords"),
    )
    absent = has_ocr.select(
        "game",
        F.inline(
            F.array_compact(
                F.array(
                    *[
                        F.when(~F.col(c), F.struct(F.lit(f"detection.ocr.{c}").alias("path"), F.lit(p).alias("problem")))
                        for c, p in (("enabled", "must be a boolean"), ("keywords", "must be a list"))
                    ]
                )
            )
        ),
    )
    rules = _rule_rows(resolved)
    named = rules.select("game", scalar(F.try_element_at("fields", F.lit("name"))).alias("name")).filter("name IS NOT NULL")
    repeated = (
        named.groupBy("game", "name")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select(
            "game",
            F.lit("detection.rules").alias("path"),
            F.format_string("duplicate name '%s'", "name").alias("problem"),
        )
    )
    out = leaves.select("game", "path", "problem")
    for part in (weights, absent, _rule_problems(rules), repeated):
        out = out.unionByName(part)
    return out
