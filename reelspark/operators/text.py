"""Keyword search over text detections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.functions import similarity
from reelspark.operators import keyword_join
from reelspark.operators.keyword_join import KeywordTable
from reelspark.operators.ordered import top_per_key


def keywords_column(keywords: Sequence[str]) -> Column:
    """Configured keywords prepared for matching, as one literal array."""
    return F.array(*[similarity.keyword_struct(k, i) for i, k in enumerate(keywords)])


def keywords_from(table: DataFrame) -> Column:
    """The same from a small table ``(kw_idx, keyword)``, as a scalar subquery - no join with the detections.

    For configured lists; the array travels in every task. Tables of any length go through ``keyword_join.prepare``.
    """
    norm = F.lower("keyword")
    prepared = table.select(
        F.struct(
            F.col("kw_idx").cast("int").alias("kw_idx"),
            "keyword",
            norm.alias("norm"),
            F.length(norm).alias("n"),
            similarity.keyword_masks(norm).alias("masks"),
        ).alias("kw")
    )
    # maps cannot be compared, so the order comes from the index alone
    ordered = F.array_sort(F.collect_list("kw"), lambda a, b: a["kw_idx"] - b["kw_idx"])
    return prepared.agg(ordered.alias("kws")).scalar()


def best_keyword(norm: Column, keywords: Column, threshold: float | Column | None, ratio=similarity.keyword_ratio) -> Column:
    """Best keyword of one text: struct<similarity, rank, keyword>; earlier keywords win ties.

    The length bound discards hopeless pairs before any character is compared.
    """
    usable = keywords if threshold is None else F.filter(
        keywords, lambda k: similarity.ratio_ceiling(norm, k) >= threshold
    )
    scored = F.transform(
        usable,
        lambda k: F.struct(
            ratio(norm, k).alias("similarity"), (-k["kw_idx"]).alias("rank"), k["keyword"].alias("keyword")
        ),
    )
    return F.array_max(scored)


def _distinct_texts(texts: DataFrame) -> DataFrame:
    """Distinct ``norm``, spread over all shuffle partitions.

    Words are few bytes but costly to compare; left to size-based coalescing they would end in one task. A shuffle by the
    plain column would merge with that of the distinct, which is coalesced.
    """
    partitions = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return texts.select("norm").distinct().repartition(partitions, F.xxhash64("norm"))


def score_texts(texts: DataFrame, keywords: Column | KeywordTable, threshold: float | None, ratio=similarity.keyword_ratio) -> DataFrame:
    """(norm) -> (norm, keyword, similarity) of the best keyword; below ``threshold`` dropped (None keeps all).

    The match leaves the row through a generator, so it is computed once, not again for every filter on it. From a
    ``KeywordTable`` texts without any similarity are left out.
    """
    if isinstance(keywords, KeywordTable):
        return keyword_join.best(texts, keywords, threshold)
    best = F.array(best_keyword(F.col("norm"), F.col("kws"), threshold, ratio))
    if threshold is not None:
        best = F.filter(best, lambda b: (b["similarity"] >= threshold) & (b["similarity"] > 0))
    found = texts.withColumn("kws", keywords).select("norm", F.explode(best).alias("b"))
    return found.select("norm", F.col("b.keyword").alias("keyword"), F.col("b.similarity").alias("similarity"))


def score_detections(
    detections: DataFrame,
    keywords: Column | KeywordTable,
    threshold: float | None = 0.8,
    ratio=similarity.keyword_ratio,
) -> DataFrame:
    """Detections with their best keyword; below ``threshold`` they are dropped (None keeps all).

    The same text shows up on frame after frame, so each distinct text is scored once (combined on the map side)
    and joined back. Few texts match, which usually lets Spark broadcast them; where it cannot, AQE splits a text
    that fills a partition.
    """
    keep = [c for c in detections.columns if c != "text"]
    prepared = detections.select(*keep, F.trim("text").alias("text")).withColumn("norm", F.lower("text"))
    distinct = prepared.select("norm").distinct() if isinstance(keywords, KeywordTable) else _distinct_texts(prepared)
    scored = score_texts(distinct, keywords, threshold, ratio)
    return prepared.join(scored, "norm").select(*keep, "text", "keyword", "similarity")


def match_keywords(
    detections: DataFrame,
    keywords: Column | KeywordTable,
    threshold: float = 0.8,
    ratio=similarity.keyword_ratio,
    keys: Sequence[str] = ("video_id", "ts_ms"),
) -> DataFrame:
    """Best detection x keyword per frame at or above ``threshold``; the earliest detection wins ties.

    ``detections(video_id, ts_ms, det_idx, text, confidence[, bbox])``.
    """
    scored = score_detections(detections, keywords, threshold, ratio)
    payload = ["keyword", "text", "confidence", "similarity"] + (["bbox"] if "bbox" in detections.columns else [])
    order = F.struct("similarity", (-F.col("det_idx")).alias("det_rank"))
    return (
        scored.groupBy(*keys)
        .agg(F.max_by(F.struct(*payload), order).alias("hit"))
        .select(*keys, *[F.col(f"hit.{c}").alias(c) for c in payload])
    )


def match_keywords_blocks(detections: DataFrame, keywords: Sequence[str], threshold: float = 0.8) -> DataFrame:
    """``match_keywords`` with the matching-blocks ratio of the tuning preview (an Arrow UDF).

    The few keywords are unrolled into columns, and each distinct text is scored once.
    """
    norm = F.lower(F.trim("text"))
    distinct = _distinct_texts(detections.select(norm.alias("norm")))
    ratios = F.array(
        *[
            F.struct(
                similarity.matching_blocks_ratio(F.col("norm"), F.lit(k.lower())).alias("similarity"),
                F.lit(-i).alias("rank"),
                F.lit(k).alias("keyword"),
            )
            for i, k in enumerate(keywords)
        ]
    )
    passing = F.filter(F.array(F.array_max(ratios)), lambda b: b["similarity"] >= threshold)
    best = distinct.select("norm", F.explode(passing).alias("best"))
    order = F.struct("best.similarity", (-F.col("det_idx")).alias("det_rank"))
    return (
        detections.withColumn("norm", norm)
        .join(best, "norm")
        .groupBy("video_id", "ts_ms")
        .agg(F.max_by(F.struct("best.keyword", F.trim("text").alias("text"), "confidence", "best.similarity"), order).alias("hit"))
        .filter("hit.similarity > 0")
        .select("video_id", "ts_ms", "hit.*")
    )


def scan_grid(centers: DataFrame, window_ms: int, step_ms: int) -> DataFrame:
    """Instants from ``max(0, c - w)`` to ``c + w`` by step (at least 1); a window of 0 or less is just the centre."""
    c = F.col("center_ms")
    if window_ms <= 0:
        return centers.withColumn("ts_ms", c)
    low = F.greatest(F.lit(0).cast("bigint"), c - window_ms)
    return centers.withColumn("ts_ms", F.explode(F.sequence(low, c + window_ms, F.lit(max(1, step_ms)).cast("bigint"))))


def scan_keywords(
    detections: DataFrame, centers: DataFrame, keywords: Column | KeywordTable, window_ms: int, step_ms: int, threshold: float = 0.8
) -> DataFrame:
    """Best match around each centre, not gated by the threshold, with detection counters.

    ``centers(video_id, center_ms)``. An instant reads as many detections as it has; each instant is first
    reduced to its best match and counts, so a centre meets at most one row per grid instant.
    """
    scored = score_detections(detections.filter(F.trim("text") != ""), keywords, None)
    counts = detections.groupBy("video_id", "ts_ms").agg(F.count(F.lit(1)).alias("n_det"))
    order = F.struct("similarity", (-F.col("det_idx")).alias("det_rank"))
    hits = scored.groupBy("video_id", "ts_ms").agg(
        F.max_by(F.struct("keyword", "text", "confidence", "similarity"), order).alias("hit")
    )
    instants = counts.join(hits, ["video_id", "ts_ms"], "left")
    grid = scan_grid(centers.select("video_id", "center_ms").distinct(), window_ms, step_ms)
    earliest_best = F.struct("hit.similarity", (-F.col("ts_ms")).alias("ts_rank"))
    return (
        grid.join(instants, ["video_id", "ts_ms"], "left")
        .groupBy("video_id", "center_ms")
        .agg(
            F.count(F.lit(1)).alias("grid_instants"),
            F.count_if(F.col("n_det") > 0).alias("frames_with_detections"),
            F.coalesce(F.sum("n_det"), F.lit(0)).alias("total_detections"),
            F.max_by(
                F.struct("hit.keyword", "hit.text", "hit.confidence", "hit.similarity", "ts_ms"),
                F.when(F.col("hit.similarity") > 0, earliest_best),
            ).alias("best"),
        )
        .select(
            "video_id",
            "center_ms",
            "grid_instants",
            "frames_with_detections",
            "total_detections",
            F.coalesce(F.col("best.similarity") >= threshold, F.lit(False)).alias("found"),
            F.col("best.keyword").alias("keyword"),
            F.col("best.text").alias("text"),
            F.coalesce("best.similarity", F.lit(0.0)).alias("similarity"),
            F.col("best.ts_ms").alias("ts_ms"),
        )
    )


def top_detections(detections: DataFrame, k: int = 10) -> DataFrame:
    """The k most confident detections of every frame (missing confidence counts as 0; earlier detection first)."""
    confidence = F.coalesce("confidence", F.lit(0.0))
    return top_per_key(detections, ["video_id", "ts_ms"], [confidence.desc(), F.col("det_idx").asc()], k)
