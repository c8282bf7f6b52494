"""The live path on Structured Streaming.

Detection and progress reuse the batch functions unchanged. Clips close by watermark, so late kills are dropped by
rule rather than by a full queue.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from reelspark.operators import detect as D
from reelspark.operators import segments, telemetry
from reelspark.operators.settings import Detection

def detect(frame_signals: DataFrame, cfg: Detection, **kwargs) -> DataFrame:
    """Events of a stream of frames with ``signals`` and ``color_pct``. Stateless; any trigger, any output mode."""
    gated = frame_signals.filter(D.gate(F.col("color_pct"), cfg.color_threshold))
    return D.decide(gated, cfg, **kwargs).filter("is_event")


def clips(
    events: DataFrame, pre_s: float = 3.0, post_s: float = 1.0, watermark: str = "10 seconds", multikill_s: float = 10.0
) -> DataFrame:
    """Merged, classified clips of ``events(video_id, ts_ms)``, emitted once no on-time event can extend them.

    Append mode. Sessions merge inside each input partition before the shuffle (see session.DEFAULTS).
    """
    gap = segments.to_ms(pre_s) + segments.to_ms(post_s)
    sessions = (
        events.withColumn("at", F.timestamp_millis("ts_ms"))
        .withWatermark("at", watermark)
        .groupBy("video_id", F.session_window("at", f"{gap} milliseconds"))
        .agg(
            F.count(F.lit(1)).alias("kill_count"),
            F.min("ts_ms").alias("first_ts_ms"),
            F.max("ts_ms").alias("last_ts_ms"),
        )
    )
    bounded = sessions.select(
        "video_id",
        F.greatest(F.lit(0).cast("bigint"), F.col("first_ts_ms") - segments.to_ms(pre_s)).alias("start_ms"),
        (F.col("last_ts_ms") + segments.to_ms(post_s)).alias("end_ms"),
        "kill_count",
        "first_ts_ms",
        "last_ts_ms",
    )
    return segments.classify(bounded, multikill_s)


def _plain(value):
    return getattr(value, "item", lambda: value)()


def _fold_progress(fields: list[str], ttl_ms: int):
    """Latest non-null value and its seq per field, for as long as the task keeps reporting."""

    def fold(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known = list(state.get) if state.exists else [None] * (2 * len(fields))
        latest_ms = state.getCurrentWatermarkMs()
        for batch in batches:
            latest_ms = max(latest_ms, int(batch["event_time"].max().timestamp() * 1000))
            batch = batch[batch["type"] == "progress"]
            for i, field in enumerate(fields):
                seen = batch.loc[batch[field].notna(), ["seq", field]]
                if len(seen):
                    top = seen.loc[seen["seq"].idxmax()]
                    if known[2 * i] is None or int(top["seq"]) > known[2 * i]:
                        known[2 * i], known[2 * i + 1] = int(top["seq"]), _plain(top[field])
        state.update(tuple(known))
        state.setTimeoutTimestamp(latest_ms + ttl_ms)
        yield pd.DataFrame({"task_id": [key[0]], **{f: [known[2 * i + 1]] for i, f in enumerate(fields)}})

    return fold


def latest_progress(
    messages: DataFrame,
    fields=tuple(telemetry.PROGRESS_FIELDS),
    ttl_ms: int | None = None,
    watermark: str = "10 minutes",
) -> DataFrame:
    """Latest value of every field per task, update mode.

    Without a TTL this is the batch aggregation run on a stream: JVM only, partial before the shuffle. With one,
    messages need ``event_time``, and a task silent for that long (by watermark) is forgotten.
    """
    if ttl_ms is None:
        return telemetry.latest_progress(messages, fields)
    fields = list(fields)
    kinds = {f: telemetry.PROGRESS_FIELDS[f] for f in fields}
    # numbers cross Arrow as doubles when some are missing, so the fold keeps them as text and casts at the end
    timed = messages.withWatermark("event_time", watermark)
    texts = timed.select("task_id", "event_time", "seq", "type", *[F.col(f).cast("string").alias(f) for f in fields])
    state = ", ".join(f"s{i} bigint, v{i} string" for i in range(len(fields)))
    key_type = messages.schema["task_id"].dataType.simpleString()
    schema = f"task_id {key_type}, " + ", ".join(f"{f} string" for f in fields)
    folded = texts.groupBy("task_id").applyInPandasWithState(
        _fold_progress(fields, ttl_ms), schema, state, "update", GroupStateTimeout.EventTimeTimeout
    )
    return folded.select("task_id", *[F.col(f).cast(t).alias(f) for f, t in kinds.items()])


def _fold_errors(n: int, ttl_ms: int | None):
    """The n latest errors of a task, oldest first, for as long as it keeps reporting some."""

    def fold(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tail = list(zip(*state.get)) if state.exists else []
        latest_ms = state.getCurrentWatermarkMs() if ttl_ms is not None else 0
        for batch in batches:
            errors = batch.nlargest(n, "seq")
            tail = sorted([*tail, *((int(s), lv, m) for s, lv, m in zip(errors["seq"], errors["level"], errors["message"]))])[-n:]
            if ttl_ms is not None:
                latest_ms = max(latest_ms, int(batch["event_time"].max().timestamp() * 1000))
        seqs, levels, texts = map(list, zip(*tail))
        state.update((seqs, levels, texts))
        if ttl_ms is not None:
            state.setTimeoutTimestamp(latest_ms + ttl_ms)
        yield pd.DataFrame({"task_id": [key[0]] * len(tail), "seq": seqs, "level": levels, "message": texts})

    return fold


def error_tail(messages: DataFrame, n: int = 50, ttl_ms: int | None = None, watermark: str = "10 minutes") -> DataFrame:
    """Each update carries the task's n latest errors; other messages are gone before the shuffle.

    State never exceeds n rows per task. With a TTL, messages need ``event_time``, and a task without errors for that long
    (by watermark) is forgotten; without one, tasks are kept for the life of the stream.
    """
    timed = messages if ttl_ms is None else messages.withWatermark("event_time", watermark)
    shaped = timed.filter(F.col("type") == "error").select(
        "task_id",
        "seq",
        F.coalesce("level", F.lit("ERROR")).alias("level"),
        F.coalesce("message", F.lit("")).alias("message"),
        *([] if ttl_ms is None else ["event_time"]),
    )
    key_type = messages.schema["task_id"].dataType.simpleString()
    return shaped.groupBy("task_id").applyInPandasWithState(
        _fold_errors(n, ttl_ms),
        f"task_id {key_type}, seq bigint, level string, message string",
        "seqs array<bigint>, levels array<string>, messages array<string>",
        "update",
        GroupStateTimeout.NoTimeout if ttl_ms is None else GroupStateTimeout.EventTimeTimeout,
    )
