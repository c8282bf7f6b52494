"""Time the headline queries: one cold run, then the median of warm ones. Prints one JSON line.

BENCH_ONLY takes comma-separated parts of names to time instead; BENCH_ONLY=all times every registered query.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from reelspark.plans.catalog import QUERIES  # noqa: E402
from reelspark.session import local_session  # noqa: E402

HEADLINE = """
kill_type_totals clip_merge_by_video clip_merge_sessions clip_kill_types clip_members kill_streaks_min2 clip_cut_plan
transition_timeline multi_video_order report_lines signal_assembly prefilter_selectivity weighted_events score_explain
rule_events detect_events detect_events_overrides preview_vs_production detection_progress template_correlation
color_coverage nearest_pairs band_annotate top_detections profile_summary span_pairing config_typed
resume_plan history_retention latest_progress stream_clips
""".split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    only = [p for p in os.environ.get("BENCH_ONLY", "").split(",") if p]
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, "bench")
    spark.read.parquet(f"{sf_dir}/events.parquet").count()
    times: dict[str, float] = {}
    for name, build in QUERIES.items():
        chosen = name in HEADLINE if not only else only == ["all"] or any(p in name for p in only)
        if not chosen:
            continue
        runs = []
        for _ in range(repeats + 1):
            start = time.perf_counter()
            build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs[1:] or runs), 3)
        print(name, [round(r, 2) for r in runs], file=sys.stderr, flush=True)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    print(
        json.dumps(
            {
                "metric": "total_warm_query_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rsplit("sf", 1)[-1].strip("/"),
                "events": events,
            }
        )
    )


if __name__ == "__main__":
    main()
