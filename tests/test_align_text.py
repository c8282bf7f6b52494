import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspark.operators import align as A
from reelspark.operators import imaging, text


@pytest.fixture(scope="module")
def sides():
    rng = random.Random(4)
    left = [(v, rng.randint(0, 3000)) for v in range(20) for _ in range(rng.randint(0, 25))]
    right = [(v, rng.randint(0, 3000)) for v in range(20) for _ in range(rng.randint(0, 12))]
    left += [(99, 500)] * 200 + [(99, rng.randint(0, 900)) for _ in range(100)]
    right += [(99, 450), (99, 550), (99, 550)]
    return left, right


def frame(spark, rows, *names):
    return spark.createDataFrame(rows, ", ".join(f"{n} bigint" for n in names))


@pytest.mark.parametrize("width", [10, 333, 10**6])
def test_previous_keyframe(spark, sides, width):
    left, right = sides
    got = A.previous_keyframe(frame(spark, left, "video_id", "start_ms"), frame(spark, right, "video_id", "keyframe_ms"), 0.6, 0.1, width=width)
    rows = got.collect()
    assert len(rows) == len(left)
    for r in rows:
        if r.start_ms <= 0:
            assert r.keyframe_ms == 0
            continue
        ok = [k for v, k in right if v == r.video_id and k <= r.start_ms + 100 and k >= max(0, r.start_ms - 600)]
        latest = max((k for v, k in right if v == r.video_id and k <= r.start_ms + 100), default=None)
        assert r.keyframe_ms == (latest if latest in ok else None)


@pytest.mark.parametrize("width", [10, 333, 10**6])
def test_nearest(spark, sides, width):
    left, right = sides
    got = {(r.video_id, r.ts_ms): r.match_ms for r in A.nearest(frame(spark, left, "video_id", "ts_ms"), frame(spark, right, "video_id", "ts_ms"), 70, width=width).collect()}
    want = {}
    for v, t in set(left):
        near = sorted((abs(m - t), m) for w, m in set(right) if w == v and abs(m - t) <= 70)
        if near:
            want[v, t] = near[0][1]
    assert got == want


@pytest.mark.parametrize("width", [1, 333])
def test_within_takes_the_first_event_strictly_inside(spark, sides, width):
    left, right = sides
    ev = [(v, t, i) for i, (v, t) in enumerate(right)]
    got = A.within(frame(spark, left, "video_id", "ts_ms"), frame(spark, ev, "video_id", "ts_ms", "event_seq"), 50, width=width).collect()
    assert len(got) == len(left)
    for r in got:
        seqs = [i for v, t, i in ev if v == r.video_id and abs(t - r.ts_ms) < 50]
        assert r.event_seq == (min(seqs) if seqs else None)


def test_offset_probe(spark):
    pairs = spark.createDataFrame([(1, 5000, 90.0), (1, 9000, 96.0), (1, 20_000, 80.0)], "video_id bigint, ts_ms bigint, similarity double")
    known = spark.createDataFrame([(1, 4000, 97.0), (1, 6000, 97.0), (1, 3000, 91.0), (1, 22_000, 80.0)], "video_id bigint, ts_ms bigint, similarity double")
    got = {r.ts_ms: (r.best_offset_ms, r.best_similarity) for r in A.offset_probe(pairs, known).collect()}
    assert got == {5000: (-1000, 97.0), 9000: (0, 96.0), 20_000: (0, 80.0)}


@pytest.mark.parametrize("values", [[1.0], [3.0, 3.0, 3.0], [0.0, 10.0], "random", "clumped"])
def test_diff_stats_quantile_is_exact(spark, values):
    rng = np.random.default_rng(1)
    if values == "random":
        values = rng.random(5000).tolist()
    elif values == "clumped":  # nearly all in one histogram bin
        values = (rng.random(5000) * 1e-9).tolist() + [1e9]
    df = spark.createDataFrame([(float(v),) for v in values], ["mae"])
    row = A.diff_stats(df).first()
    assert row.n == len(values) and row.max == max(values)
    assert row["mean"] == pytest.approx(np.mean(values))
    assert row["quantile"] == pytest.approx(np.percentile(values, 95), rel=1e-12)


def test_verdicts(spark):
    df = spark.createDataFrame([(v,) for v in (95.1, 95.0, 85.1, 85.0, None)], "similarity double")
    assert [r[0] for r in df.select(A.timing_verdict(F.col("similarity"))).collect()] == ["match", "warning", "warning", "mismatch", "mismatch"]


def test_keyword_match_examples(spark):
    rows = [(1, 0, 0, " KIILL ", 0.7), (1, 0, 1, "kill", 0.4), (1, 0, 2, "KILL", 0.9), (1, 1, 0, "HEALTH", 0.99), (1, 2, 0, "", 0.5)]
    dets = spark.createDataFrame(rows, "video_id int, ts_ms bigint, det_idx int, text string, confidence double")
    got = text.match_keywords(dets, text.keywords_column(["KILL", "kill"]), 0.8).collect()
    assert [(r.ts_ms, r.keyword, r.text, r.confidence, r.similarity) for r in got] == [(0, "KILL", "kill", 0.4, 1.0)]
    table = spark.createDataFrame([(0, "KILL"), (1, "kill")], "kw_idx int, keyword string")
    assert text.match_keywords(dets, text.keywords_from(table), 0.8).collect() == got


def test_scan_reports_below_threshold(spark):
    dets = spark.createDataFrame([(1, 1000, 0, "hill", 0.5), (1, 2000, 0, "xx", 0.5)], "video_id int, ts_ms bigint, det_idx int, text string, confidence double")
    centers = spark.createDataFrame([(1, 1500), (1, 9000)], "video_id int, center_ms bigint")
    got = {r.center_ms: r for r in text.scan_keywords(dets, centers, text.keywords_column(["KILL"]), 500, 500, 0.8).collect()}
    assert got[1500].grid_instants == 3 and got[1500].frames_with_detections == 2 and got[1500].total_detections == 2
    assert not got[1500].found and got[1500].similarity == 0.75 and got[1500].ts_ms == 1000
    assert got[9000].keyword is None and got[9000].total_detections == 0


def test_template_correlation_blocks_agree(spark):
    rng = np.random.default_rng(2)
    names = [f"t{i}" for i in range(40)]
    vecs = rng.random((40, 8))
    patches = np.vstack([rng.random((25, 8)), vecs[:3] * 2 + 1, np.ones((1, 8))])
    t = spark.createDataFrame([(n, v.tolist()) for n, v in zip(names, vecs)] + [("big", [1.0] * 9)], "name string, vec array<double>")
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(patches)], "patch_id int, vec array<double>")
    small = {r.patch_id: (r.template, round(r.score, 9)) for r in imaging.template_correlation(p, t).collect()}
    large = {r.patch_id: (r.template, round(r.score, 9)) for r in imaging.template_correlation(p, t, block=6).collect()}
    assert small == large
    for i in range(28):
        scores = [np.corrcoef(patches[i], v)[0, 1] for v in vecs]
        assert small[i] == (names[int(np.argmax(scores))], pytest.approx(max(scores), abs=1e-8))
    nothing = imaging.template_correlation(p, t.filter("name = 'big'")).first()
    assert (nothing.template, nothing.score) == (None, -1.0)


def test_sliding_templates(spark):
    rng = np.random.default_rng(3)
    image = rng.integers(0, 256, (12, 16), dtype=np.uint8)
    df = spark.createDataFrame([(1, 16, 12, bytearray(image.tobytes()))], "image_id int, width int, height int, grey binary")
    got = {r.template: r for r in imaging.slide_templates(df, {"hit": image[4:9, 7:12].astype(float), "huge": np.zeros((20, 20))}).collect()}
    assert (got["hit"].x, got["hit"].y) == (7, 4) and got["hit"].score == pytest.approx(1.0)
    assert got["huge"].score == -1.0 and got["huge"].x is None


def test_packed_and_pixel_coverage_agree(spark):
    rng = np.random.default_rng(4)
    image = rng.integers(0, 256, (6, 5, 3), dtype=np.uint8)
    bounds = {"a": ([0, 0, 100], [90, 255, 255]), "b": ([100, 100, 0], [179, 255, 255])}
    packed = spark.createDataFrame([(1, 5, 6, bytearray(image.tobytes()))], "image_id int, width int, height int, bgr binary")
    pix = spark.createDataFrame([(1, int(b), int(g), int(r)) for b, g, r in image.reshape(-1, 3)], "image_id int, b int, g int, r int")
    a = {r.color: r.pct for r in imaging.color_coverage(packed, bounds).collect()}
    b = {r.color: r.pct for r in imaging.coverage_from_pixels(pix, bounds).collect()}
    assert a == pytest.approx(b) and 0 < a["a"] < 1
    assert {r.pct for r in imaging.color_coverage(packed, bounds, [0.0, 0.0, 0.1, 0.1]).collect()} == {0.0}
