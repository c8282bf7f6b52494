"""Settings and lineage as tables: every customer is a game, its orders write the layers of its settings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from reelspark.operators import config as CF
from reelspark.operators import lineage as L
from reelspark.operators import rules as R
from reelspark.operators.runs import STAGES
from reelspark.plans.inputs import query, table
from reelspark.session import durable, shared_folder
from reelspark.sources import ingest

# candidate leaves per layer: (path, values as JSON text); an order picks a path and one of its values
DEFAULTS = [
    ("config_version", ["1", "2"]),
    ("video.frame_extraction_mode", ['"bulk"', '"precise"']),
    ("video.frame_interval_ms", ["1000", "500"]),
    ("highlights.pre_kill_time", ["3.0"]),
    ("highlights.music_volume", ["0.5", "1.5"]),
    ("detection.confidence_threshold", ["0.5", '"0.6"', '"x"']),
    ("detection.ocr.enabled", ["false"]),
    ("detection.ocr.keywords", ['["击杀","KILL"]']),
    ("detection.ocr.threshold", ["0.7"]),
    ("detection.weights.ocr", ["0.4"]),
    ("detection.weights.color", ["0.2"]),
    ("detection.prefilter.color_threshold", ["0.01"]),
    ("detection.templates", ["{}"]),
    ("ai.batch_size", ["16"]),
    ("global.output_dir", ['"out"']),
]
GAME = [
    ("video.frame_extraction_mode", ['"fast"', '"bulk"']),
    ("highlights.pre_kill_time", ["-1", "2", '"long"']),
    ("detection.killfeed_roi", ["[0.1,0.1,0.5,0.5]", "[0,0,2,1]", "[0.5]", "[0,0,1,0]"]),
    ("detection.ocr.enabled", ["true", '"yes"']),
    ("detection.ocr.keywords", ['["ACE"]', '"KILL"']),
    ("detection.ocr.similarity_threshold", ["0.85", "1.5"]),
    ("detection.weights.yolo", ["0.1", "-0.1", "0"]),
    ("detection.weights.color", ["0", "0.3"]),
    ("detection.templates.t0.threshold", ["0.9"]),
    ("detection.templates.t0.roi", ["[0,0,1,1]", "[2,0,1,1]"]),
    ("detection.colors.red.hsv_lower", ["[0,100,100]", "[190,0,0]", "[1,2]"]),
    ("detection.prefilter.enabled", ["false", '"off"']),
    ("detection.rules", [
        '[{"name":"a","enabled":true,"require":["ocr"]}]',
        '[{"name":"a","enabled":true,"require":["ocr"]},{"name":"a","enabled":"no","require":[]}]',
        '[{"name":" ","enabled":true,"require":["speed"]}]',
        '[{"name":"b","enabled":true,"require":["yolo"],"detection_overrides":{"killfeed_roi":[0,0,0,1],"ocr":{"similarity_threshold":7}}}]',
    ]),
]
OVERRIDE = [
    ("video.frame_interval_ms.fine", ["250"]),
    ("highlights", ["{}", "null"]),
    ("detection.ocr", ["{}", "true"]),
    ("detection.templates.t1.threshold", ["0.6"]),
    ("detection.weights.template", ["0.3"]),
    ("global.output_dir", ['"elsewhere"', '"out"']),
    ("detection.prefilter.color_threshold", ["2", "0.05"]),
]


def _values_sql(name: str, choices) -> str:
    rows = ", ".join(
        f"({i}, {j}, {len(values)}, '{path}', '{v}')" for i, (path, values) in enumerate(choices) for j, v in enumerate(values)
    )
    return f"{name}(i, j, n, path, value) AS (VALUES {rows})"


LAYERS = f"""{_values_sql("vd", DEFAULTS)}, {_values_sql("vg", GAME)}, {_values_sql("vo", OVERRIDE)},
games AS (SELECT c_custkey AS game, c_nationkey % 5 AS base FROM customer),
dflt AS (SELECT game, path, value FROM games JOIN vd ON vd.j = base % vd.n),
gl AS (SELECT o_custkey AS game, path, max(value) AS value FROM orders JOIN vg
       ON vg.i = o_orderkey % {len(GAME)} AND vg.j = o_orderkey // {len(GAME)} % vg.n WHERE o_orderkey % 5 > 0 GROUP BY ALL),
ov AS (SELECT o_custkey AS game, path, max(value) AS value FROM orders JOIN vo
       ON vo.i = o_orderkey // 5 % {len(OVERRIDE)} AND vo.j = o_orderkey // 7 % vo.n WHERE o_orderkey % 5 = 0 GROUP BY ALL)"""

_SECTION = "regexp_extract(u.path, '^detection\\.(ocr|templates|colors|weights|prefilter)(\\.|$)')"


def _merge_sql(out: str, base: str, update: str, replaced: bool) -> str:
    section = f"rtrim({_SECTION}, '.')" if replaced else "''"
    return f"""{out}_u AS (SELECT u.*, {section} AS section FROM {update} u
    WHERE NOT (u.value = '{{}}' AND {section} = '' AND EXISTS (
      SELECT 1 FROM {base} b WHERE b.game = u.game AND starts_with(b.path, u.path || '.')))),
{out} AS (SELECT game, path, value FROM {base} b WHERE NOT EXISTS (
    SELECT 1 FROM {out}_u u WHERE u.game = b.game AND (b.path = u.path OR starts_with(b.path, u.path || '.')
      OR starts_with(u.path, b.path || '.')
      OR (u.section <> '' AND (b.path = u.section OR starts_with(b.path, u.section || '.')))))
  UNION ALL SELECT game, path, value FROM {out}_u)"""


RESOLVED = f"""{LAYERS}, {_merge_sql("own", "dflt", "gl", True)}, {_merge_sql("res", "own", "ov", False)}"""


def _pick(choices, idx, sub):
    """struct<path,value> for a path index and a value counter."""
    table_ = F.array(
        *[
            F.struct(F.lit(path).alias("path"), F.array(*[F.lit(v) for v in values]).alias("values"))
            for path, values in choices
        ]
    )
    entry = F.get(table_, idx.cast("int"))
    return entry["path"], F.get(entry["values"], (sub % F.size(entry["values"])).cast("int"))


def layers(spark, sf):
    games = table(spark, sf, "customer").select(F.col("c_custkey").alias("game"), (F.col("c_nationkey") % 5).alias("base"))
    bases = games.select("base").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(len(DEFAULTS) - 1))))
    path, value = _pick(DEFAULTS, F.col("i"), F.col("base"))
    defaults = bases.select("base", path.alias("path"), value.alias("value"))
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("game"), F.col("o_orderkey").alias("key"))

    def layer(rows, choices, idx, sub):
        path, value = _pick(choices, idx, sub)
        return rows.select("game", path.alias("path"), value.alias("value")).groupBy("game", "path").agg(F.max("value").alias("value"))

    key, n = F.col("key"), len(GAME)
    own = layer(orders.filter(key % 5 > 0), GAME, key % n, F.floor(key / n))
    over = layer(orders.filter(key % 5 == 0), OVERRIDE, F.floor(key / 5) % len(OVERRIDE), F.floor(key / 7))
    # orders may name customers that do not exist here; their layers have no game to join
    known = lambda df: df.join(games.select("game"), "game", "left_semi")
    return games, defaults, known(own), known(over)


KNOWN = RESOLVED.replace("FROM orders JOIN", "FROM (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)) JOIN")


def resolved(spark, sf):
    return CF.resolve(*layers(spark, sf))


@query("config_resolved", f"WITH {KNOWN} SELECT game, path, value FROM res")
def config_resolved(spark, sf):
    return resolved(spark, sf)


@query(
    "config_unknown_games",
    f"WITH {KNOWN} SELECT game FROM games WHERE game NOT IN (SELECT game FROM gl)",
)
def config_unknown_games(spark, sf):
    games, _, own, _ = layers(spark, sf)
    return CF.unknown_games(games, own)


def _at(path):
    return f"max(CASE WHEN path = '{path}' THEN json_extract_string('{{\"v\":' || value || '}}', '$.v') END)"


def _bool(path, default):
    return f"""CASE WHEN lower(trim({_at(path)})) IN ('true','1','yes','on') THEN TRUE
      WHEN lower(trim({_at(path)})) IN ('false','0','no','off') THEN FALSE ELSE {default} END"""


def _raw(path):
    return f"max(CASE WHEN path = '{path}' THEN value END)"


ROI_SQL = f"json_extract({_raw('detection.killfeed_roi')}, '$[*]')"


@query(
    "config_typed",
    f"""WITH {KNOWN} SELECT game,
    CASE WHEN len({ROI_SQL}) = 4 THEN array_to_string(list_transform({ROI_SQL}, lambda x: printf('%.3f', CAST(x AS DOUBLE))), ',')
         ELSE '0.000,0.000,1.000,1.000' END AS killfeed_roi,
    coalesce(try_cast({_at('detection.confidence_threshold')} AS DOUBLE), 0.5) AS confidence_threshold,
    coalesce(try_cast({_at('detection.weights.ocr')} AS DOUBLE), 0.4) AS weight_ocr,
    coalesce(try_cast({_at('detection.weights.template')} AS DOUBLE), 0.3) AS weight_template,
    coalesce(try_cast({_at('detection.weights.color')} AS DOUBLE), 0.2) AS weight_color,
    coalesce(try_cast({_at('detection.weights.yolo')} AS DOUBLE), 0.1) AS weight_yolo,
    {_bool('detection.ocr.enabled', 'FALSE')} AS ocr_enabled, {_bool('detection.ocr.required', 'FALSE')} AS ocr_required,
    CASE WHEN {_raw('detection.ocr.keywords')} IS NULL THEN '击杀,KILL' WHEN {_raw('detection.ocr.keywords')} LIKE '[%'
         THEN array_to_string(json_extract_string({_raw('detection.ocr.keywords')}, '$[*]'), ',') ELSE '' END AS keywords,
    CASE WHEN {_raw('detection.ocr.similarity_threshold')} IS NOT NULL
         THEN coalesce(try_cast({_at('detection.ocr.similarity_threshold')} AS DOUBLE), 0.8)
         ELSE coalesce(try_cast({_at('detection.ocr.threshold')} AS DOUBLE), 0.8) END AS similarity_threshold,
    {_bool('detection.prefilter.enabled', 'TRUE')} AS prefilter_enabled,
    coalesce(try_cast({_at('detection.prefilter.color_threshold')} AS DOUBLE), 0.01) AS color_threshold,
    coalesce(try_cast({_at('video.frame_interval_ms')} AS INTEGER), 1000) AS frame_interval_ms,
    coalesce({_at('video.frame_extraction_mode')}, 'bulk') AS frame_extraction_mode,
    CAST(round(coalesce(try_cast({_at('highlights.pre_kill_time')} AS DOUBLE), 3.0) * 1000) AS BIGINT) AS pre_kill_ms,
    CAST(1000 AS BIGINT) AS post_kill_ms FROM res GROUP BY game""",
)
def config_typed(spark, sf):
    t = CF.typed(resolved(spark, sf))
    return t.select(
        "game",
        F.array_join(F.transform("killfeed_roi", lambda v: F.format_string("%.3f", v)), ",").alias("killfeed_roi"),
        "confidence_threshold",
        *[f"weight_{s}" for s in ("ocr", "template", "color", "yolo")],
        "ocr_enabled",
        "ocr_required",
        F.array_join("keywords", ",").alias("keywords"),
        "similarity_threshold",
        "prefilter_enabled",
        "color_threshold",
        "frame_interval_ms",
        "frame_extraction_mode",
        "pre_kill_ms",
        "post_kill_ms",
    )


NUM = "CASE WHEN regexp_matches(value, '^-?[0-9]') THEN try_cast(value AS DOUBLE) END"
LIST = "CASE WHEN value LIKE '[%' THEN list_transform(json_extract(value, '$[*]'), lambda x: try_cast(x AS DOUBLE)) END"
BAD_ROI = """CASE WHEN coalesce(len(l), 0) <> 4 THEN 'must be a list of 4 numbers'
  WHEN len(list_filter(l, lambda x: x < 0 OR x > 1)) > 0 THEN 'values must be between 0.0 and 1.0'
  WHEN l[3] <= 0 OR l[4] <= 0 THEN 'width and height must be greater than 0' END"""


@query(
    "config_violations",
    f"""WITH {KNOWN}, x AS (SELECT *, {NUM} AS num, {LIST} AS l FROM res),
    leaf AS (SELECT game, path, CASE
        WHEN path = 'config_version' AND value <> 'null' THEN CASE WHEN coalesce(num, 0) <> 1 THEN 'must be 1' END
        WHEN path = 'video.frame_extraction_mode' THEN CASE WHEN value NOT IN ('"bulk"', '"precise"') THEN 'must be ''bulk'' or ''precise''' END
        WHEN path IN ('highlights.pre_kill_time', 'highlights.post_kill_time') THEN CASE WHEN NOT coalesce(num >= 0, FALSE) THEN 'must be a non-negative number' END
        WHEN path IN ('highlights.game_volume', 'highlights.music_volume', 'detection.ocr.similarity_threshold', 'detection.prefilter.color_threshold')
          THEN CASE WHEN NOT coalesce(num BETWEEN 0 AND 1, FALSE) THEN 'must be between 0 and 1' END
        WHEN path = 'detection.killfeed_roi' OR path LIKE 'detection.templates.%.roi' THEN {BAD_ROI}
        WHEN path LIKE 'detection.colors.%.hsv_lower' THEN CASE WHEN coalesce(len(l), 0) <> 3 THEN 'must be a list of 3 numbers'
          WHEN NOT l[1] BETWEEN 0 AND 180 THEN 'hue must be between 0 and 180' END
        WHEN path = 'detection.ocr.enabled' THEN CASE WHEN value NOT IN ('true', 'false') THEN 'must be a boolean' END
        WHEN path = 'detection.ocr.keywords' THEN CASE WHEN value NOT LIKE '[%' THEN 'must be a list' END
        WHEN path LIKE 'detection.weights.%' THEN CASE WHEN NOT coalesce(num >= 0, FALSE) THEN 'must be a non-negative number' END
      END AS problem FROM x),
    w AS (SELECT game, 'detection.weights' AS path, 'must contain at least one positive value' AS problem FROM x
          WHERE path LIKE 'detection.weights.%' GROUP BY game HAVING max(coalesce(num, 0)) <= 0),
    o AS (SELECT game, bool_or(path = 'detection.ocr.enabled') AS e, bool_or(path = 'detection.ocr.keywords') AS k FROM res
          WHERE path LIKE 'detection.ocr.%' GROUP BY game),
    r AS (SELECT game, CAST(key AS INTEGER) AS pos, rule FROM (SELECT game, value FROM res WHERE path = 'detection.rules') t,
          LATERAL (SELECT unnest(range(len(json_extract(t.value, '$[*]')))) AS key, unnest(json_extract(t.value, '$[*]')) AS rule)),
    rp AS (
      SELECT game, 'detection.rules[' || pos || '].name' AS path, 'must be a non-empty string' AS problem FROM r WHERE trim(rule->>'$.name') = ''
      UNION ALL SELECT game, 'detection.rules[' || pos || '].enabled', 'must be a boolean' FROM r WHERE json_type(rule, '$.enabled') <> 'BOOLEAN'
      UNION ALL SELECT game, 'detection.rules[' || pos || '].require', 'must not be empty' FROM r WHERE json_array_length(rule, '$.require') = 0
      UNION ALL SELECT game, 'detection.rules[' || pos || '].require', 'unknown signal' FROM r WHERE rule->>'$.require[0]' NOT IN ('ocr','template','color','yolo')
      UNION ALL SELECT game, 'detection.rules[' || pos || '].detection_overrides.killfeed_roi', 'width and height must be greater than 0' FROM r
        WHERE rule->>'$.detection_overrides.killfeed_roi[2]' = '0'
      UNION ALL SELECT game, 'detection.rules[' || pos || '].detection_overrides.ocr.similarity_threshold', 'must be between 0 and 1' FROM r
        WHERE CAST(rule->>'$.detection_overrides.ocr.similarity_threshold' AS DOUBLE) > 1),
    dup AS (SELECT game, 'detection.rules' AS path, 'duplicate name ''' || (rule->>'$.name') || '''' AS problem FROM r
            GROUP BY game, rule->>'$.name' HAVING count(*) > 1)
    SELECT game, path, problem FROM leaf WHERE problem IS NOT NULL
    UNION ALL SELECT * FROM w UNION ALL SELECT game, 'detection.ocr.enabled', 'must be a boolean' FROM o WHERE NOT e
    UNION ALL SELECT game, 'detection.ocr.keywords', 'must be a list' FROM o WHERE NOT k
    UNION ALL SELECT * FROM rp UNION ALL SELECT * FROM dup""",
)
def config_violations(spark, sf):
    return CF.violations(resolved(spark, sf))


EFFECTIVE = f"""WITH {KNOWN}, base AS (SELECT game, substr(path, 11) AS path, value FROM dflt WHERE starts_with(path, 'detection.')),
o AS (SELECT game, 'rule' AS rule, substr(path, 11) AS path, value FROM gl WHERE starts_with(path, 'detection.') AND path <> 'detection.rules'),
sec AS (SELECT game, split_part(path, '.', 1) AS section, bool_or(contains(path, '.')) AS nested FROM base GROUP BY ALL),
oc AS (SELECT o.*, CASE WHEN contains(path, '.') AND coalesce(nested, FALSE) THEN split_part(path, '.', 1) || '.' || split_part(path, '.', 2)
              ELSE split_part(path, '.', 1) END AS cleared FROM o LEFT JOIN sec ON sec.game = o.game AND sec.section = split_part(o.path, '.', 1))
SELECT b.game, r.rule, b.path, b.value FROM base b JOIN (SELECT DISTINCT game, rule FROM o) r USING (game)
WHERE NOT EXISTS (SELECT 1 FROM oc WHERE oc.game = b.game AND oc.rule = r.rule AND (b.path = cleared OR starts_with(b.path, cleared || '.')))
UNION ALL SELECT game, rule, path, value FROM oc"""


@query("effective_config", EFFECTIVE)
def effective_config(spark, sf):
    """Per-rule settings: the game layer's detection leaves as one rule's overrides on the defaults."""
    games, defaults, own, _ = layers(spark, sf)
    inside = lambda df: df.filter(F.col("path").startswith("detection.")).withColumn(
        "path", F.substr("path", F.lit(11))
    )
    base = inside(games.join(defaults, "base").select("game", "path", "value"))
    over = inside(own).filter(F.col("path") != "rules").withColumn("rule", F.lit("rule"))
    return R.effective_config(base, over.select("game", "rule", "path", "value"))


def _hash_sql(src: str) -> str:
    doc = "string_agg(length(path) || ':' || path || ':' || length(value) || ':' || value, chr(10) ORDER BY path, value)"
    return f"""(SELECT game, split_part(path, '.', 1) AS section, substr(sha256({doc}), 1, 16) AS hash FROM {src}
      WHERE split_part(path, '.', 1) IN ('video','ai','detection','highlights','global') GROUP BY ALL
      UNION ALL SELECT game, 'config', substr(sha256({doc}), 1, 16) FROM {src} GROUP BY ALL)"""


PRINTS = f"{KNOWN}, fo AS {_hash_sql('own')}, fn AS {_hash_sql('res')}"


def prints(spark, sf):
    games, defaults, own, over = layers(spark, sf)
    # the layers are merged twice, and each table of hashes is read several times by what follows
    own = durable(own)
    old, new = CF.resolve(games, defaults, own), CF.resolve(games, defaults, own, over)
    return durable(L.fingerprints(old)), durable(L.fingerprints(new))


@query("config_fingerprints", f"WITH {PRINTS} SELECT game, section, hash FROM fn")
def config_fingerprints(spark, sf):
    return L.fingerprints(resolved(spark, sf))


DIFF = f"""{PRINTS}, df AS (SELECT coalesce(fo.game, fn.game) AS game, coalesce(fo.section, fn.section) AS section, fo.hash AS old_hash, fn.hash AS new_hash
  FROM fo FULL JOIN fn ON fo.game = fn.game AND fo.section = fn.section WHERE fo.hash IS DISTINCT FROM fn.hash)"""


@query("fingerprint_diff", f"WITH {DIFF} SELECT * FROM df")
def fingerprint_diff(spark, sf):
    return L.diff_fingerprints(*prints(spark, sf))


STAGE_SQL = "['metadata','frames','detection','clips','join','audio','report','history','cleanup']"
EARLIEST = f"""{DIFF}, ch AS (SELECT game, bool_or(section = 'config') AS whole,
    min(CASE section WHEN 'video' THEN 1 WHEN 'ai' THEN 2 WHEN 'detection' THEN 2 WHEN 'highlights' THEN 3 WHEN 'global' THEN 5 END) AS i
    FROM df GROUP BY game),
es AS (SELECT g.game, CASE WHEN whole THEN {STAGE_SQL}[i + 1] END AS stage, CASE WHEN whole THEN i END AS idx FROM games g LEFT JOIN ch USING (game))"""


@query("earliest_stage", f"WITH {EARLIEST} SELECT game, stage FROM es")
def earliest_stage(spark, sf):
    return L.earliest_stage(*prints(spark, sf))


STAGES_SQL = f"""st AS (SELECT c_custkey AS video_id, {STAGE_SQL}[i + 1] AS stage, CAST(i AS INTEGER) AS idx,
    CASE WHEN (c_custkey * 3 + i * 5) % 11 < 9 THEN 'SUCCESS' WHEN (c_custkey * 3 + i * 5) % 11 = 9 THEN 'FAILED' ELSE 'PENDING' END AS status
    FROM (SELECT c_custkey, unnest(range(9)) AS i FROM customer WHERE c_custkey % 13 > 0))"""


def stages(spark, sf):
    mark = (F.col("c_custkey") * 3 + F.col("i") * 5) % 11
    return (
        table(spark, sf, "customer")
        .filter(F.col("c_custkey") % 13 > 0)
        .select("c_custkey", F.posexplode(F.array(*[F.lit(s) for s in STAGES])).alias("i", "stage"))
        .select(
            F.col("c_custkey").alias("video_id"),
            "stage",
            F.when(mark < 9, "SUCCESS").when(mark == 9, "FAILED").otherwise("PENDING").alias("status"),
        )
    )


@query(
    "invalidate_stages",
    f"""WITH {EARLIEST}, {STAGES_SQL} SELECT video_id, st.stage, CASE WHEN st.idx >= es.idx THEN 'PENDING' ELSE status END AS status,
    coalesce(st.idx >= es.idx, FALSE) AS invalidated, CASE WHEN coalesce(st.idx >= es.idx, FALSE) THEN
      CASE st.stage WHEN 'frames' THEN 'frames' WHEN 'detection' THEN 'events,detection_json' WHEN 'clips' THEN 'clips'
        WHEN 'join' THEN 'joined_video' WHEN 'audio' THEN 'final_video' WHEN 'report' THEN 'report_path' ELSE '' END ELSE '' END AS cleared
    FROM st LEFT JOIN es ON es.game = st.video_id""",
)
def invalidate_stages(spark, sf):
    since = L.earliest_stage(*prints(spark, sf)).withColumnRenamed("game", "video_id")
    return L.invalidate(stages(spark, sf), since).withColumn("cleared", F.array_join("cleared", ","))


MISSING = f"""{STAGES_SQL},
refs AS (SELECT o_custkey AS video_id, ['frames','detection','clips','join','audio','report'][o_orderkey % 6 + 1] AS stage,
         CASE WHEN o_orderkey % 40 > 0 THEN 'p/' || o_orderkey END AS path FROM orders),
inv AS (SELECT 'p/' || l_orderkey AS path, bool_or(l_orderkey % 5 > 0) AS parses FROM lineitem GROUP BY l_orderkey HAVING max(l_quantity) > 20),
ms AS (SELECT r.video_id, r.stage, count(*) AS missing FROM refs r JOIN st ON st.video_id = r.video_id AND st.stage = r.stage AND st.status = 'SUCCESS'
       LEFT JOIN inv USING (path) WHERE inv.path IS NULL OR (r.stage = 'detection' AND NOT parses) GROUP BY ALL)"""


def missing(spark, sf):
    key = F.col("o_orderkey")
    names = F.array(*[F.lit(s) for s in ("frames", "detection", "clips", "join", "audio", "report")])
    refs = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("video_id"),
        F.get(names, (key % 6).cast("int")).alias("stage"),
        F.when(key % 40 > 0, F.concat(F.lit("p/"), key)).alias("path"),
    )
    kept = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_quantity").alias("q")).filter("q > 20")
    inventory = kept.select(F.concat(F.lit("p/"), "l_orderkey").alias("path"), (F.col("l_orderkey") % 5 > 0).alias("parses"))
    return L.missing_artifacts(stages(spark, sf), refs, inventory)


@query("missing_artifacts", f"WITH {MISSING} SELECT * FROM ms")
def missing_artifacts(spark, sf):
    return missing(spark, sf)


@query(
    "resume_plan",
    f"""WITH {EARLIEST}, {MISSING},
    inval AS (SELECT ms.video_id, min(idx) AS f FROM ms JOIN st USING (video_id, stage) GROUP BY ms.video_id),
    v AS (SELECT c_custkey AS video_id, unnest(range(9)) AS i FROM customer)
    SELECT v.video_id, CAST(v.i AS INTEGER) AS stage_idx, {STAGE_SQL}[v.i + 1] AS stage,
      CASE WHEN st.status = 'SUCCESS' AND v.i < coalesce(least(inval.f, es.idx), 9) THEN 'SKIP' ELSE 'RUN' END AS action
    FROM v LEFT JOIN st ON st.video_id = v.video_id AND st.idx = v.i LEFT JOIN inval ON inval.video_id = v.video_id
    LEFT JOIN es ON es.game = v.video_id""",
)
def resume_plan(spark, sf):
    videos = table(spark, sf, "customer").select(F.col("c_custkey").alias("video_id"))
    changed = L.earliest_stage(*prints(spark, sf)).withColumnRenamed("game", "video_id")
    return L.resume_plan(videos, stages(spark, sf), L.first_invalid(missing(spark, sf)), changed)


CHECKPOINTS = """ck AS (SELECT c_custkey AS video_id, CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 4 END AS version, 'v/' || c_custkey AS video_path,
  CASE c_custkey % 3 WHEN 0 THEN 'v/' || c_custkey WHEN 1 THEN '' ELSE 'v/other' END AS saved_path FROM customer)"""


@query(
    "usable_checkpoints",
    f"""WITH {CHECKPOINTS} SELECT video_id FROM ck WHERE coalesce(version, 1) >= 2 AND (saved_path = '' OR saved_path = video_path)""",
)
def usable_checkpoints(spark, sf):
    key = F.col("c_custkey")
    own = F.concat(F.lit("v/"), key)
    found = table(spark, sf, "customer").select(
        key.alias("video_id"),
        F.when(key % 5 > 0, (key % 4).cast("int")).alias("version"),
        own.alias("video_path"),
        F.when(key % 3 == 0, own).when(key % 3 == 1, "").otherwise("v/other").alias("saved_path"),
    )
    return L.usable_checkpoints(found).select("video_id")


@query(
    "checkpoint_references",
    """WITH c AS (SELECT c_custkey AS v FROM customer)
    SELECT v AS video_id, 'frames' AS stage, unnest(CASE WHEN v % 5 = 0 THEN [NULL] ELSE ['f/' || v || '/0', 'f/' || v || '/1'] END) AS path FROM c
    UNION ALL SELECT v, 'detection', CASE WHEN v % 4 > 0 THEN 'd/' || v END FROM c
    UNION ALL SELECT v, 'clips', unnest(['c/' || v, NULL]) FROM c WHERE v % 3 > 0
    UNION ALL SELECT v, 'join', 'j/' || v FROM c UNION ALL SELECT v, 'audio', NULL FROM c UNION ALL SELECT v, 'report', 'r/' || v FROM c""",
)
def checkpoint_references(spark, sf):
    v = F.col("c_custkey")
    at = lambda p, s="": F.concat(F.lit(f"{p}/"), v, F.lit(s))
    none = F.array().cast("array<string>")
    docs = table(spark, sf, "customer").select(
        v.alias("video_id"),
        F.when(v % 5 == 0, none).otherwise(F.array(at("f", "/0"), at("f", "/1"))).alias("frames"),
        F.when(v % 4 > 0, at("d")).otherwise("").alias("detection_json"),
        F.when(v % 3 > 0, F.array(at("c"), F.lit(""))).alias("clips"),
        at("j").alias("joined_video"),
        F.lit(None).cast("string").alias("final_video"),
        at("r").alias("report_path"),
    )
    return L.references(docs)


@query(
    "resume_from_checkpoints",
    f"""WITH c AS (SELECT c_custkey AS v FROM customer WHERE c_custkey % 5 > 0 AND c_custkey % 4 >= 2),
    sx AS (SELECT unnest(range(9)) AS i),
    s AS (SELECT v, i, {STAGE_SQL}[i + 1] AS stage FROM c, sx WHERE (v * 7 + i * 3) % 8 > 0),
    r AS (SELECT v, 'frames' AS stage, unnest(['p/' || (v * 4), 'p/' || (v * 4 + 1)]) AS path FROM c WHERE v % 7 > 0
          UNION ALL SELECT v, 'frames', NULL FROM c WHERE v % 7 = 0
          UNION ALL SELECT v, 'detection', 'p/' || (v * 4 + 2) FROM c
          UNION ALL SELECT v, 'clips', 'p/' || (v * 4 + 3) FROM c WHERE v % 2 = 0
          UNION ALL SELECT v, 'join', NULL FROM c UNION ALL SELECT v, 'audio', 'p/' || v FROM c UNION ALL SELECT v, 'report', NULL FROM c),
    inv AS (SELECT DISTINCT 'p/' || l_orderkey AS path, l_orderkey % 3 > 0 AS parses FROM lineitem),
    bad AS (SELECT r.v, min(s.i) AS i FROM r JOIN s ON s.v = r.v AND s.stage = r.stage LEFT JOIN inv USING (path)
            WHERE inv.path IS NULL OR (r.stage = 'detection' AND NOT parses) GROUP BY r.v),
    ch AS (SELECT c_custkey AS v, 3 AS i FROM customer WHERE c_custkey % 11 = 0)
    SELECT a.c_custkey AS video_id, CAST(sx.i AS INTEGER) AS stage_idx, {STAGE_SQL}[sx.i + 1] AS stage,
      CASE WHEN s.v IS NOT NULL AND sx.i < coalesce(least(bad.i, ch.i), 9) THEN 'SKIP' ELSE 'RUN' END AS action
    FROM customer a CROSS JOIN sx LEFT JOIN s ON s.v = a.c_custkey AND s.i = sx.i LEFT JOIN bad ON bad.v = a.c_custkey LEFT JOIN ch ON ch.v = a.c_custkey""",
)
def resume_from_checkpoints(spark, sf):
    """Checkpoint documents parsed, weighed against a bucketed inventory, and turned into a plan, in one chain."""
    v = F.col("c_custkey")
    at = lambda n: F.concat(F.lit("p/"), n)
    done = F.filter(F.array(*[F.lit(i) for i in range(len(L.STAGES))]), lambda i: (v * 7 + i * 3) % 8 > 0)
    names = F.array(*[F.lit(s) for s in L.STAGES])
    stages = F.map_from_entries(F.transform(done, lambda i: F.struct(F.get(names, i), F.struct(F.lit("SUCCESS").alias("status")))))
    results = F.struct(
        F.when(v % 7 > 0, F.array(at(v * 4), at(v * 4 + 1))).alias("frames"),
        at(v * 4 + 2).alias("detection_json"),
        F.when(v % 2 == 0, F.array(F.struct(at(v * 4 + 3).alias("path")))).alias("clips"),
        at(v).alias("final_video"),
    )
    document = F.struct(F.when(v % 5 > 0, (v % 4).cast("int")).alias("checkpoint_version"), F.concat(F.lit("v/"), v).alias("video_path"), stages.alias("stages"), results.alias("results"))
    documents = table(spark, sf, "customer").select(F.concat(F.lit("ck/"), v, F.lit(".json")).alias("source_path"), F.to_json(document).alias("json"))
    number = F.regexp_extract("checkpoint_path", r"ck/(\d+)", 1).cast("bigint")
    parsed = ingest.parse_checkpoints(documents).withColumns({"video_id": number, "video_path": F.concat(F.lit("v/"), number)})
    paths = table(spark, sf, "lineitem").select(at(F.col("l_orderkey")).alias("path"), (F.col("l_orderkey") % 3 > 0).alias("parses"))
    name = f"inventory_{uuid.uuid4().hex[:12]}"
    inventory = L.store_inventory(paths, name, f"{shared_folder(spark)}/{name}", int(spark.conf.get("spark.sql.shuffle.partitions")))
    videos = table(spark, sf, "customer").select(v.alias("video_id"))
    changed = videos.filter("video_id % 11 = 0").select("video_id", F.lit(L.STAGES[3]).alias("stage"))
    return L.resume_from_checkpoints(videos, parsed, inventory, changed)
