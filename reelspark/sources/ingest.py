"""Readers and parsers for what surrounds the videos: listings, probes, logs, recorded events, checkpoints."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark import schemas
from reelspark.functions import fmt, parse
from reelspark.operators.ordered import BUCKET_ROWS, numbered

#: Extensions a batch run picks up from folders, and the wider set of the catalogue view.
BATCH_EXTS = (".mp4", ".avi", ".mkv", ".mov")
CATALOG_EXTS = (".mp4", ".avi", ".mkv", ".mov", ".wmv", ".flv", ".webm")

#: The line shapes of frame logs, tried in this order.
FRAME_LOG_PATTERNS = (
    r"showinfo.*? n:\s*(\d+).*? pts_time:\s*([0-9\.]+)",
    r"\[showinfo\].*?n:\s*(\d+).*?pts_time:\s*([0-9\.]+)",
    r"n:\s*(\d+).*?pts_time:\s*([0-9\.]+)",
)


def _extension(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[^./\\]+)$", 1)


def _found(spark: SparkSession, root: str) -> list[bool]:
    """Whether each path that ``root`` names, wildcards included, is a folder; a few names of the driver's, never their contents."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return [status.isDirectory() for status in found or ()]


def list_files(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """(path, length, modified, root_idx, explicit) of files at the roots; file contents are never read.

    A root that names an existing folder lists that folder, whatever its name looks like; any other names files
    explicitly, by itself or by wildcards. A root at which there is nothing lists nothing.
    """
    listed = spark.createDataFrame([], "path string, length bigint, modified timestamp, root_idx int, explicit boolean")
    for idx, root in enumerate(roots):
        found = _found(spark, root)
        explicit = any(c in root for c in "*?[{") or found == [False]
        if not found or all(found) and explicit:
            continue
        listed = listed.unionByName(
            spark.read.format("binaryFile")
            .load(root)
            .select(
                "path",
                "length",
                F.col("modificationTime").alias("modified"),
                F.lit(idx).alias("root_idx"),
                F.lit(explicit).alias("explicit"),
            )
        )
    return listed


def inventory_of(
    files: DataFrame, exts: Sequence[str] = BATCH_EXTS, order: str = "input", *, rows: int = BUCKET_ROWS
) -> DataFrame:
    """Videos among listed files, one row per path.

    ``input``: folder files with an all-lower or all-upper extension from ``exts``, explicit files always; in order
    of the roots, then extension, then path; ``seq`` is the position. ``name``: catalogue view - extension in any
    case, sorted by lower-cased name, with a readable size.
    """
    ext = _extension(F.col("path"))
    if order == "name":
        name = F.substring_index("path", "/", -1)
        return (
            files.filter(F.lower(ext).isin(*exts))
            .groupBy("path")
            .agg(F.max("length").alias("length"))
            .select("path", name.alias("name"), "length", fmt.size(F.col("length")).alias("size_formatted"))
            .orderBy(F.lower("name"), "path")
        )
    known = list(exts) + [e.upper() for e in exts]
    rank = F.array_position(F.array(*[F.lit(x) for e in exts for x in (e, e.upper())]), ext)
    kept = files.filter(F.col("explicit") | ext.isin(*known))
    first = kept.groupBy("path").agg(
        F.min(F.struct("root_idx", rank.alias("rank"))).alias("first"), F.max("length").alias("length")
    )
    # one order over all partitions, each bucket's offset a sum over the buckets before it
    keyed = first.select("path", "length", "first.root_idx", "first.rank")
    sized = keyed.withColumn("one", F.lit(0)).withColumn(
        "slot", (F.col("root_idx") * 1000 + F.col("rank")).cast("bigint")
    )
    return numbered(sized, ["one"], "slot", "seq", rows=rows, tie=["path"]).drop("one", "slot", "rank")


def video_inventory(
    spark: SparkSession, roots: Sequence[str], exts: Sequence[str] | None = None, order: str = "input"
) -> DataFrame:
    """List videos under folders, wildcards and files."""
    chosen = exts or (CATALOG_EXTS if order == "name" else BATCH_EXTS)
    return inventory_of(list_files(spark, roots), chosen, order)


def _probe(documents: DataFrame, kind: str) -> DataFrame:
    """Add doc (parsed), ok (it parses) and stream (first stream of the kind)."""
    parsed = documents.withColumns(
        {
            "doc": F.from_json("json", schemas.PROBE_DOC),
            "ok": F.try_parse_json("json").isNotNull() & (F.trim("json") != ""),
        }
    )
    streams = F.coalesce(F.col("doc.streams"), F.from_json(F.lit("[]"), parsed.schema["doc"].dataType["streams"].dataType))
    return parsed.withColumn("stream", F.get(F.filter(streams, lambda s: s["codec_type"] == kind), F.lit(0)))


def read_video_probe(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Probe documents (video_id, json) -> (videos, rejected).

    Rejected are documents that do not parse or have no video stream, with the reason.
    """
    probed = _probe(documents, "video")
    good = probed.filter(F.col("ok") & F.col("stream").isNotNull())
    videos = good.select(
        "video_id",
        F.coalesce("stream.width", F.lit(0)).alias("width"),
        F.coalesce("stream.height", F.lit(0)).alias("height"),
        parse.fps(F.coalesce("stream.r_frame_rate", F.lit("0/0"))).alias("fps"),
        parse.as_float(F.col("doc.format.duration"), 0.0).alias("duration_s"),
        F.coalesce(F.col("doc.format.bit_rate").try_cast("bigint"), F.lit(0)).cast("bigint").alias("bitrate"),
        F.coalesce("stream.codec_name", F.lit("unknown")).alias("codec"),
        F.nullif(F.col("stream.nb_frames"), F.lit("N/A")).try_cast("bigint").alias("total_frames"),
    )
    reason = F.when(~F.col("ok"), "unparsable document").otherwise("no video stream")
    rejected = probed.filter(~F.coalesce("ok", F.lit(False)) | F.col("stream").isNull())
    return videos, rejected.select("video_id", F.coalesce(reason, F.lit("unparsable document")).alias("reason"))


def read_audio_probe(documents: DataFrame) -> DataFrame:
    """Probe documents -> audio metadata with presence has_audio / no_audio / probe_failed."""
    probed = _probe(documents, "audio")
    presence = (
        F.when(~F.coalesce("ok", F.lit(False)), "probe_failed")
        .when(F.col("stream").isNotNull(), "has_audio")
        .otherwise("no_audio")
    )
    return probed.withColumn("audio", presence).select(
        "video_id",
        "audio",
        parse.as_float(F.col("doc.format.duration"), 0.0).alias("duration_s"),
        F.col("doc.format.format_name").alias("format"),
        F.col("stream.sample_rate").try_cast("int").alias("sample_rate"),
        F.col("stream.channels").try_cast("int").alias("channels"),
        F.coalesce(F.col("doc.format.bit_rate").try_cast("bigint"), F.lit(0)).cast("bigint").alias("bit_rate"),
        F.col("stream.codec_name").alias("codec"),
    )


def parse_frame_log(lines: DataFrame, offset_ms: int = 0) -> DataFrame:
    """Frame log lines (video_id, line) -> (video_id, n, pts_time, ts_ms); other lines are dropped."""
    hit = lambda group: F.coalesce(
        *[F.nullif(F.regexp_extract("line", p, group), F.lit("")) for p in FRAME_LOG_PATTERNS]
    )
    pts = hit(2).try_cast("double")
    return (
        lines.select("video_id", hit(1).try_cast("bigint").alias("n"), pts.alias("pts_time"))
        .filter(F.col("n").isNotNull() & F.col("pts_time").isNotNull())
        .withColumn("ts_ms", F.bround(F.col("pts_time") * 1000).cast("bigint") + offset_ms)
    )


def logs_without_frames(lines: DataFrame, frames: DataFrame) -> DataFrame:
    """Videos whose log gave no frame at all - an error for the caller."""
    return lines.select("video_id").distinct().join(frames.select("video_id").distinct(), "video_id", "left_anti")


def frame_grid(videos: DataFrame, interval_ms: int) -> DataFrame:
    """Regular sample instants 0, i, 2i ... strictly below the duration of ``videos(video_id, duration_s)``."""
    last = F.ceil(F.col("duration_s") * 1000).cast("bigint") - 1
    return videos.filter(F.col("duration_s") > 0).select(
        "video_id", F.explode(F.sequence(F.lit(0).cast("bigint"), last, F.lit(interval_ms).cast("bigint"))).alias("ts_ms")
    )


def read_keyframes(lines: DataFrame) -> DataFrame:
    """Packet lines ``pts_time,flags`` of (video_id, line) -> (video_id, keyframe_ms) of key packets."""
    parts = F.transform(F.split(F.trim("line"), ","), lambda p: F.trim(p))
    pts = F.get(parts, F.lit(0)).try_cast("double")
    is_key = F.contains(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), F.lit("K"))
    return lines.filter((F.size(parts) >= 2) & is_key & pts.isNotNull()).select(
        "video_id", F.bround(pts * 1000).cast("bigint").alias("keyframe_ms")
    )


def coerce_events(raw: DataFrame) -> DataFrame:
    """Recorded event documents with defaults: instant 0, confidence 0, type kill, empty maps.

    Recorded form keeps signals under ``meta``; plain form has them on top.
    """
    empty = F.create_map().cast("map<string,double>")
    keep = [c for c in raw.columns if c in ("video_id", "source_path")]
    return raw.select(
        *keep,
        F.coalesce(F.col("timestamp_ms").try_cast("bigint"), F.lit(0).cast("bigint")).alias("ts_ms"),
        parse.as_float(F.col("confidence"), 0.0).alias("confidence"),
        F.coalesce("type", F.lit("kill")).alias("type"),
        F.coalesce(F.col("meta.signals"), F.col("signals"), empty).alias("signals"),
        F.coalesce(F.col("meta.frame_path"), F.lit("")).alias("frame_path"),
    )


def read_events(spark: SparkSession, path: str, *, documents: bool = True) -> DataFrame:
    """Recorded events under ``path``. ``documents``: one JSON array per file; otherwise JSON lines (splittable)."""
    raw = spark.read.schema(schemas.EVENT_DOC).option("multiLine", documents).json(path)
    return coerce_events(raw.withColumn("source_path", F.col("_metadata.file_path")))


def read_clip_metadata(spark: SparkSession, path: str, *, documents: bool = True, strict: bool = False):
    """Clip metadata -> (valid, rejected); a clip needs ``path`` or ``output_path``. ``strict`` fails the job instead."""
    raw = spark.read.schema(schemas.CLIP_DOC).option("multiLine", documents).json(path)
    return split_clip_metadata(raw, strict)


def split_clip_metadata(raw: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    found = F.coalesce(F.nullif(F.col("path"), F.lit("")), F.nullif(F.col("output_path"), F.lit("")))
    label = F.coalesce(F.col("id").cast("string"), F.lit("unknown"))
    message = F.concat(F.lit("clip "), label, F.lit(" has no path"))
    tagged = raw.withColumn("clip_path", found)
    if strict:
        tagged = tagged.withColumn("clip_path", F.coalesce("clip_path", F.raise_error(message).cast("string")))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    valid = tagged.filter(F.col("clip_path").isNotNull()).select(
        "id", "clip_path", zero("start_ms"), zero("end_ms"), zero("kill_count"), "kill_type", "filename", "source_video"
    )
    return valid, tagged.filter(F.col("clip_path").isNull()).select(message.alias("error"))


def _documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("source_path"), F.col("value").alias("json")
    )


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Profile documents, one per run -> a row per run and step."""
    return _documents(spark, path).select(
        "source_path", F.explode(F.from_json("json", schemas.PROFILE_DOC)).alias("step", "s")
    ).select("source_path", "step", "s.count", "s.total", "s.avg", "s.min", "s.max")


def parse_checkpoints(documents: DataFrame) -> DataFrame:
    """(source_path, json) of checkpoints and their ``.bak`` copies -> one row per checkpoint.

    The primary counts when it parses, else the backup; when neither does the checkpoint is dropped. Columns as
    ``operators.lineage`` takes them.
    """
    is_backup = F.col("source_path").endswith(".bak")
    parsed = documents.filter(F.try_parse_json("json").isNotNull() & (F.trim("json") != "")).select(
        F.regexp_replace("source_path", r"\.bak$", "").alias("checkpoint_path"),
        is_backup.alias("is_backup"),
        F.from_json("json", schemas.CHECKPOINT_DOC).alias("doc"),
    )
    best = parsed.groupBy("checkpoint_path").agg(F.min_by("doc", "is_backup").alias("doc"), F.min("is_backup").alias("from_backup"))
    clip = lambda c: F.coalesce(F.nullif(c["path"], F.lit("")), F.nullif(c["output_path"], F.lit("")))
    return best.select(
        "checkpoint_path",
        "from_backup",
        F.col("doc.checkpoint_version").alias("version"),
        F.col("doc.video_path").alias("saved_path"),
        F.col("doc.fingerprints").alias("fingerprints"),
        F.transform_values("doc.stages", lambda _, s: s["status"]).alias("stages"),
        F.col("doc.results.frames").alias("frames"),
        F.col("doc.results.detection_json").alias("detection_json"),
        F.transform("doc.results.clips", clip).alias("clips"),
        F.col("doc.results.joined_video").alias("joined_video"),
        F.col("doc.results.final_video").alias("final_video"),
        F.col("doc.results.report_path").alias("report_path"),
    )


def read_checkpoints(spark: SparkSession, path: str) -> DataFrame:
    return parse_checkpoints(_documents(spark, path))
