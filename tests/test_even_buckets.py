"""Buckets bounded by rows, exact quantiles beside outliers, distributed numbering, ranks above the group limit."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from reelspark.operators import align, profile
from reelspark.operators.ordered import Run, laid_out, numbered, running, top_per_key
from reelspark.plans.catalog import QUERIES
from reelspark.sources import ingest


@pytest.fixture(scope="module")
def crowded(spark):
    """Nine tenths of all rows at one instant of one key; some NULL keys."""
    rng = random.Random(4)
    rows = [(1, 500, i, rng.randrange(100)) for i in range(9000)]
    rows += [(rng.choice([1, 2, 3, None]), rng.randrange(1000), 9000 + i, rng.randrange(100)) for i in range(1000)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k bigint, t bigint, seq bigint, v bigint").repartition(7).cache()


def test_buckets_are_bounded_by_rows(crowded):
    sizes = [r["count"] for r in laid_out(crowded, ["k"], "t", ["seq"], 256).groupBy("__bucket").count().collect()]
    assert sum(sizes) == 10_000 and max(sizes) <= 256 and len(sizes) >= 40
    # even without a tie-breaker, and for equal rows of one place
    sizes = [r["count"] for r in laid_out(crowded.select("k", "t"), ["k"], "t", (), 256).groupBy("__bucket").count().collect()]
    assert sum(sizes) == 10_000 and max(sizes) <= 256


def test_running_by_rows_matches_the_loop(crowded):
    runs = {
        "before": Run("sum", F.col("v")),
        "upto": Run("bit_xor", F.col("v"), "through"),
        "nearest": Run("last", F.when(F.col("v") < 10, F.col("v")), "after"),
        "n": Run("sum", F.lit(1).cast("bigint"), "through"),
    }
    got = {r.seq: r for r in running(crowded, ["k"], "t", runs, tie=["seq"], rows=128).collect()}
    by_key = {}
    for r in sorted(crowded.collect(), key=lambda r: (r.t, r.seq)):
        by_key.setdefault(r.k, []).append(r)
    for rows in by_key.values():
        total = xor = 0
        for i, r in enumerate(rows):
            xor ^= r.v
            found = got[r.seq]
            assert (found.before or 0, found.upto, found.n) == (total, xor, i + 1)
            assert found.nearest == next((x.v for x in rows[i + 1 : i + 300] if x.v < 10), found.nearest)
            total += r.v


def test_spans_of_marks_at_one_instant(spark):
    marks = [(1, "s", 7, i, ("start", "end")[i % 2]) for i in range(2000)]
    out = profile.pair_spans(spark.createDataFrame(marks, "run_id int, step string, ts_ms bigint, seq bigint, mark string"), rows=64)
    assert out.count() == 1000 and out.filter("unmatched or duration_ms <> 0").count() == 0


@pytest.mark.parametrize("outlier", [None, 1e300, -1e300, float("inf")])
@pytest.mark.parametrize("q", [0.0, 0.37, 0.95, 1.0])
def test_quantile_beside_an_outlier(spark, outlier, q):
    rng = random.Random(9)
    values = [rng.gauss(0, 1) for _ in range(997)] + [0.0, -0.0, 3.5, 3.5] + ([] if outlier is None else [outlier])
    row = align.diff_stats(spark.createDataFrame([(v,) for v in [*values, None]], "mae double"), q=q).first()
    ordered = sorted(values)
    at = (len(values) - 1) * q
    lo, hi = ordered[int(at)], ordered[min(len(values) - 1, int(at) + (at > int(at)))]
    want = lo if lo == hi else lo + (hi - lo) * (at - int(at))
    assert row.n == len(values) and row.max == max(values) and row.quantile == pytest.approx(want, rel=1e-12)
    if outlier is None:
        assert row.mean == pytest.approx(statistics.fmean(values))


def test_bins_never_fall_and_outliers_do_not_coarsen_them(spark):
    rng = random.Random(5)
    values = sorted([rng.gauss(50, 5) for _ in range(3000)] + [1e308, 5e-324, -5e-324, 0.0, 2.0**40, 2.0**40 - 1, float("inf"), float("-inf")] + [2.0**i for i in range(-1074, 1024, 7)])
    bins = [r.b for r in spark.createDataFrame([(v,) for v in values], "v double").repartition(1).select("v", align.magnitude_bin(F.col("v")).alias("b")).orderBy("v").collect()]
    assert bins == sorted(bins)
    crowd = [b for v, b in zip(values, bins) if 30 < v < 70]
    assert max(crowd.count(b) for b in set(crowd)) < len(crowd) / 20
    assert align.diff_stats(spark.createDataFrame([], "mae double")).first().n == 0


def test_quantile_reads_its_input_once(spark, tmp_path):
    spark.range(100).select(F.col("id").cast("double").alias("mae")).write.parquet(str(tmp_path / "in"))
    plan = align.diff_stats(spark.read.parquet(str(tmp_path / "in")))._jdf.queryExecution().toString()
    assert str(tmp_path) not in plan


def test_numbering_of_one_folder_spreads(spark):
    files = spark.range(200_000).select(
        F.concat(F.lit("/a/v"), F.col("id"), F.lit(".mp4")).alias("path"), F.lit(1).cast("bigint").alias("length"), F.lit(0).alias("root_idx"), F.lit(False).alias("explicit")
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few bytes are one partition again
    try:
        out = ingest.inventory_of(files, rows=4096)
        parts = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(parts) == 200_000 and max(parts) < 60_000
    seen = out.agg(F.count_distinct("seq").alias("n"), F.min("seq").alias("a"), F.max("seq").alias("b")).first()
    assert (seen.n, seen.a, seen.b) == (200_000, 1, 200_000)
    ordered = [r.path for r in out.orderBy("seq").limit(50).collect()]
    assert ordered == sorted(ordered)


def test_folders_with_dots_and_missing_files(spark, tmp_path):
    dotted = tmp_path / "clips.2024"
    (dotted / "deep.mp4").mkdir(parents=True)
    (dotted / "a.mp4").write_bytes(b"x")
    (dotted / "b.txt").write_bytes(b"x")
    (tmp_path / "plain").write_bytes(b"x")
    out = ingest.video_inventory(spark, [str(dotted), str(tmp_path / "gone.mp4"), f"{tmp_path}/no*.mp4", str(tmp_path / "plain")])
    assert [r.path.rsplit("/", 1)[-1] for r in out.orderBy("seq").collect()] == ["a.mp4", "plain"]
    assert ingest.video_inventory(spark, []).count() == 0


def test_high_ranks_meet_in_two_stages(spark):
    rows = spark.range(40_000).select(F.floor(F.col("id") / 10**9).alias("k"), F.pmod(F.col("id") * 7919, F.lit(40_009)).alias("v"), "id")
    top = top_per_key(rows, ["k"], [F.col("v"), F.col("id")], 5000)
    want = sorted((i * 7919 % 40_009, i) for i in range(40_000))[:5000]
    assert [(r.v, r.id) for r in top.orderBy("rank").collect()] == want
    assert top._jdf.queryExecution().executedPlan().toString().count("Window [") == 2
    few = top_per_key(rows, ["k"], [F.col("v"), F.col("id")], 50)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in few and few.count("Window [") == 1


def exchanges(df, hint="hashpartitioning"):
    return df._jdf.queryExecution().executedPlan().toString().count(f"Exchange {hint}")


def test_null_safe_keys_keep_the_partitioning(spark, monkeypatch):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.createDataFrame([(None, 0, 5), ("a", 3, 6)], "k string, t long, v int")
        out = running(rows, ["k"], "t", {"s": Run("sum", F.col("v"), "through")})
        # rows, summaries, summaries by key, and these back to the rows' partitioning
        assert exchanges(out) == 4
        assert exchanges(numbered(rows, ["k"], "t", "n")) == 4
        from reelspark.operators import segments

        padded = segments.pad(spark.createDataFrame([(None, 9), (1, 4)], "video_id long, ts_ms long"))
        joined = segments.members(padded)
        assert "<=>" not in joined._jdf.queryExecution().executedPlan().toString() and exchanges(joined, "hashpartitioning(coalesce") == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_queries_are_planned_with_round_one_exchanges(spark):
    plan = QUERIES["transition_timeline"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "<=>" not in plan
