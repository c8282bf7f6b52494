"""Fingerprints of settings, invalidation of stages, and the plan of what to run again.

A run of many videos is planned at once: the output of ``resume_plan`` tells which (video, stage) partitions need
work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.functions import hashing
from reelspark.operators.runs import STAGES

#: Tracked settings sections with the stage a change invalidates, the results each stage owns, and
#: the oldest checkpoint version still usable.
SECTION_STAGE = {
    "video": "frames",
    "ai": "detection",
    "detection": "detection",
    "highlights": "clips",
    "global": "audio",
}
STAGE_RESULTS = {
    "frames": ["frames"],
    "detection": ["events", "detection_json"],
    "clips": ["clips"],
    "join": ["joined_video"],
    "audio": ["final_video"],
    "report": ["report_path"],
}
CHECKPOINT_VERSION = 2

WHOLE = "config"


def _literal_map(pairs: dict[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def _stage_index() -> Column:
    return _literal_map({name: i for i, name in enumerate(STAGES)})


def stage_index(stage: Column) -> Column:
    """Position of a stage in the run; NULL for unknown stages."""
    return F.try_element_at(_stage_index(), stage)


def fingerprints(configs: DataFrame, key: str = "game") -> DataFrame:
    """(key, section, hash): one row per tracked section present, and ``config`` over everything.

    ``configs(key, path, value)``; a document's rows are few, so each hash is taken over one small group. Each row counts
    for its section and for the whole in one pass, so settings that lie by key already are not shuffled again.
    """
    section = F.substring_index("path", ".", 1)
    counted = F.array_compact(F.array(F.when(section.isin(*SECTION_STAGE), section), F.lit(WHOLE)))
    digest = hashing.stable_hash(hashing.canonical(F.collect_list(F.struct("path", "value"))))
    return configs.select(key, "path", "value", F.explode(counted).alias("section")).groupBy(key, "section").agg(digest.alias("hash"))


def diff_fingerprints(old: DataFrame, new: DataFrame, key: str = "game") -> DataFrame:
    """Sections whose hash differs between two fingerprint tables; absent differs from present."""
    a = old.select(key, "section", F.col("hash").alias("old_hash"))
    b = new.select(key, "section", F.col("hash").alias("new_hash"))
    return a.join(b, [key, "section"], "full").filter(~F.col("old_hash").eqNullSafe(F.col("new_hash")))


def earliest_stage(old: DataFrame, new: DataFrame, key: str = "game") -> DataFrame:
    """(key, stage): first stage to redo after a change of settings.

    NULL when the whole hash is equal, or when only untracked settings changed.
    """
    idx = F.try_element_at(_literal_map({s: STAGES.index(st) for s, st in SECTION_STAGE.items()}), F.col("section"))
    changed = (
        diff_fingerprints(old, new, key)
        .groupBy(key)
        .agg(F.bool_or(F.col("section") == WHOLE).alias("whole"), F.min(idx).alias("idx"))
    )
    keys = old.select(key).unionByName(new.select(key)).distinct()
    stage = F.get(F.array(*[F.lit(s) for s in STAGES]), F.col("idx"))
    return keys.join(changed, key, "left").select(key, F.when(F.col("whole"), stage).alias("stage"))


def invalidate(stages: DataFrame, from_stage: DataFrame, key: str = "video_id") -> DataFrame:
    """Reset a stage and all later ones.

    ``stages(key, stage, status)``, ``from_stage(key, stage)``; unknown or NULL stages invalidate nothing.
    Adds ``invalidated`` and the result names to clear.
    """
    since = from_stage.select(key, stage_index(F.col("stage")).alias("from_idx"))
    hit = F.coalesce(stage_index(F.col("stage")) >= F.col("from_idx"), F.lit(False))
    owned = F.create_map(
        *[x for s, names in STAGE_RESULTS.items() for x in (F.lit(s), F.array(*[F.lit(n) for n in names]))]
    )
    nothing = F.array().cast("array<string>")
    return stages.join(since, key, "left").withColumn("invalidated", hit).select(
        key,
        "stage",
        F.when(F.col("invalidated"), "PENDING").otherwise(F.col("status")).alias("status"),
        "invalidated",
        F.when(F.col("invalidated"), F.coalesce(F.try_element_at(owned, F.col("stage")), nothing))
        .otherwise(nothing)
        .alias("cleared"),
    )


def usable_checkpoints(checkpoints: DataFrame) -> DataFrame:
    """Checkpoints new enough whose saved path, when given, is the video's own.

    ``checkpoints(video_id, version, video_path, saved_path, ...)``. A missing version counts as 1; newer
    versions pass.
    """
    version = F.coalesce("version", F.lit(1))
    saved = F.coalesce("saved_path", F.lit(""))
    return checkpoints.filter((version >= CHECKPOINT_VERSION) & ((saved == "") | (saved == F.col("video_path"))))


def references(checkpoints: DataFrame) -> DataFrame:
    """(video_id, stage, path): every file a checkpoint relies on; path NULL where one should be named but is not.

    ``checkpoints(video_id, frames, detection_json, clips, joined_video, final_video, report_path)`` with arrays of
    paths for frames and clips. No frames at all is a missing reference, no clips is fine.
    """
    one = lambda c: F.array(F.nullif(F.col(c), F.lit("")))
    no_path = F.array(F.lit(None).cast("string"))
    by_stage = {
        "frames": F.when(F.size(F.coalesce("frames", F.array().cast("array<string>"))) == 0, no_path).otherwise(F.col("frames")),
        "detection": one("detection_json"),
        "clips": F.transform(F.coalesce("clips", F.array().cast("array<string>")), lambda p: F.nullif(p, F.lit(""))),
        "join": one("joined_video"),
        "audio": one("final_video"),
        "report": one("report_path"),
    }

    def entries(stage: str, paths: Column) -> Column:
        return F.transform(paths, lambda p: F.struct(F.lit(stage).alias("stage"), p.alias("path")))

    both = F.flatten(F.array(*[entries(stage, paths) for stage, paths in by_stage.items()]))
    return checkpoints.select("video_id", F.inline(both))


def missing_artifacts(stages: DataFrame, refs: DataFrame, inventory: DataFrame) -> DataFrame:
    """Per video and SUCCESS stage: how many of its files are missing.

    ``stages(video_id, stage, status)``, ``refs(video_id, stage, path)``, ``inventory(path, parses)``; a detection
    document must also parse. Stages without files are always valid and do not appear.
    """
    done = stages.filter(F.col("status") == "SUCCESS").select("video_id", "stage")
    wanted = refs.join(done, ["video_id", "stage"], "left_semi")
    present = inventory.groupBy("path").agg(F.bool_or("parses").alias("parses"))
    good = F.col("parses").isNotNull() & ((F.col("stage") != "detection") | F.col("parses"))
    # what names no file is missing without a look; all of it together would be one key of the join
    named = wanted.filter(F.col("path").isNotNull()).join(present, "path", "left").select("video_id", "stage", (~F.coalesce(good, F.lit(False))).alias("gone"))
    nameless = wanted.filter(F.col("path").isNull()).select("video_id", "stage", F.lit(True).alias("gone"))
    return named.unionByName(nameless).groupBy("video_id", "stage").agg(F.count_if("gone").alias("missing")).filter("missing > 0")


def store_inventory(inventory: DataFrame, name: str, path: str, buckets: int) -> DataFrame:
    """``inventory(path, parses)`` as a table bucketed by path: whoever joins it on the path shuffles only the other side."""
    rows = inventory.groupBy("path").agg(F.bool_or("parses").alias("parses"))
    rows.write.mode("overwrite").option("path", path).bucketBy(buckets, "path").sortBy("path").saveAsTable(name)
    return inventory.sparkSession.table(name)


def resume_from_checkpoints(videos: DataFrame, checkpoints: DataFrame, inventory: DataFrame, changed: DataFrame) -> DataFrame:
    """RUN or SKIP for every (video, stage), straight from checkpoints.

    ``checkpoints`` as from ``ingest.parse_checkpoints`` with ``video_id`` and ``video_path``: the usable ones give the stages and
    name the files; files that are not in ``inventory(path, parses)`` and ``changed(video_id, stage)`` settings cut the plan.
    """
    usable = usable_checkpoints(checkpoints)
    stages = usable.select("video_id", F.explode("stages").alias("stage", "status"))
    return resume_plan(videos, stages, first_invalid(missing_artifacts(stages, references(usable), inventory)), changed)


def first_invalid(missing: DataFrame) -> DataFrame:
    """(video_id, stage): earliest stage with missing files."""
    return missing.groupBy("video_id").agg(F.min_by("stage", stage_index(F.col("stage"))).alias("stage"))


def resume_plan(
    videos: DataFrame, stages: DataFrame, invalid: DataFrame, changed: DataFrame
) -> DataFrame:
    """RUN or SKIP for every (video, stage).

    ``videos(video_id)``; ``stages(video_id, stage, status)`` from usable checkpoints only, so a video without
    one runs everything; ``invalid(video_id, stage)`` from missing files; ``changed(video_id, stage)`` from
    settings. Only SUCCESS stages before the earliest of the two are skipped. A missing joined video under
    existing clips shows up as an invalid join stage, which re-runs join and audio.
    """
    statuses = stages.groupBy("video_id").agg(
        F.map_from_entries(F.collect_list(F.struct("stage", "status"))).alias("known")
    )
    since = lambda df, name: df.groupBy("video_id").agg(
        F.min(stage_index(F.col("stage"))).alias(name)
    )
    names = F.array(*[F.lit(s) for s in STAGES])
    cut = F.coalesce(F.least("by_files", "by_settings"), F.lit(len(STAGES)))
    done = F.coalesce(F.try_element_at("known", F.col("stage")) == "SUCCESS", F.lit(False))
    return (
        videos.select("video_id")
        .distinct()
        .join(statuses, "video_id", "left")
        .join(since(invalid, "by_files"), "video_id", "left")
        .join(since(changed, "by_settings"), "video_id", "left")
        .select("video_id", "known", cut.alias("cut"), F.posexplode(names).alias("stage_idx", "stage"))
        .select(
            "video_id",
            "stage_idx",
            "stage",
            F.when(done & (F.col("stage_idx") < F.col("cut")), "SKIP").otherwise("RUN").alias("action"),
        )
    )
