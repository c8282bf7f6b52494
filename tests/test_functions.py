from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from reelspark.functions import color, fmt, fusion, parse, roi, similarity
from reelspark.operators import text


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_durations_and_clock(spark):
    row = one(
        spark,
        fmt.duration(F.lit("3661")),
        fmt.duration(F.lit(None).cast("string")),
        fmt.duration(F.lit("nope")),
        fmt.duration(F.lit("-5")),
        fmt.duration(F.lit("360000")),
        fmt.ms(F.lit(3_661_500)),
        fmt.ms(F.lit(25 * 3_600_000)),
    )
    assert tuple(row) == ("01:01:01", "00:00:00", "00:00:00", "00:00:00", "100:00:00", "01:01:01.500", "01:00:00.000")


def test_sizes_and_titles(spark):
    row = one(spark, fmt.size(F.lit(0)), fmt.size(F.lit(1280)), fmt.size(F.lit(5 * 1024**3)), fmt.size(F.lit(2 * 1024**6)), fmt.title(F.lit("double_kill")))
    assert tuple(row) == ("0.0 B", "1.2 KB", "5.0 GB", "2048.0 PB", "Double Kill")


def test_parsers(spark):
    row = one(
        spark,
        parse.fps(F.lit("30000/1001")),
        parse.fps(F.lit("5/0")),
        parse.fps(F.lit("3.5/2")),
        parse.fps(F.lit("59.94")),
        parse.fps(F.lit("1/2/3")),
        parse.resolution(F.lit("1920x1080"))["height"],
        parse.resolution(F.lit("1920"))["width"],
        parse.as_bool(F.lit(" Yes "), False),
        parse.as_bool(F.lit("maybe"), True),
        parse.frame_ts_from_name(F.lit("a/frame_1200_3.jpg")),
        parse.frame_ts_from_name(F.lit("cover.jpg")),
    )
    assert tuple(row) == (30000 / 1001, 0.0, 0.0, 59.94, 0.0, 1080, None, True, True, 1200, 0)


def test_rois(spark):
    arr = lambda *v: F.array(*[F.lit(x) for x in v])
    row = one(
        spark,
        roi.normalize(arr("0.1", "x", "0.3", "0.4")),
        roi.normalize(arr(-0.1, 0.2, 3.0, 0.4)),
        roi.normalize_clamped(arr(-0.5, 0.5, 2.0, 0.75)),
        roi.normalize_clamped(arr(1.0, 0.0, 0.5, 0.5)),
        roi.clip_pixels(arr(-10, 5, 30, 10), F.lit(15), F.lit(100)),
        roi.clip_pixels(arr(50, 5, 30, 10), F.lit(15), F.lit(100)),
        roi.relative_box(F.array(arr(10.0, 20.0), arr(30.0, 20.0), arr(30.0, 60.0), arr(10.0, 60.0)), arr(0.0, 0.0, 0.5, 0.5), F.lit(100), F.lit(200)),
    )
    assert list(map(lambda v: v and list(v), row)) == [
        [0.0, 0.0, 1.0, 1.0],
        [-0.1, 0.2, 3.0, 0.4],
        [0.0, 0.5, 1.0, 0.5],
        [0.0, 0.0, 1.0, 1.0],
        [0, 5, 15, 15],
        None,
        [0.2, 0.2, 0.4, 0.4],
    ]


def test_hsv_bounds(spark):
    arr = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    none = F.lit(None).cast("array<double>")
    cases = [
        (arr(1, 2, 3), arr(4, 5, 6), arr(9, 9, 9), arr(5), ([1, 2, 3], [4, 5, 6])),
        (none, none, arr(10, 100, 100), arr(5, 10, 10), ([5, 90, 90], [15, 110, 110])),
        (none, none, arr(10, 100, 100), arr(5), ([5, 90, 90], [15, 110, 110])),
        (none, none, arr(2, 250, 5), arr(10, 20, 30), ([0, 230, 0], [12, 255, 35])),
        (none, none, arr(2, 250, 5), arr(10, 20), None),
        (none, none, none, none, None),
    ]
    for lower, upper, center, tol, want in cases:
        got = one(spark, color.hsv_bounds(lower, upper, center, tol))[0]
        assert (got and (list(got.lower), list(got.upper))) == want


@pytest.mark.parametrize(
    "rgb, hsv", [((255, 0, 0), (0, 255, 255)), ((0, 255, 0), (60, 255, 255)), ((0, 0, 255), (120, 255, 255)), ((7, 7, 7), (0, 0, 7)), ((0, 0, 0), (0, 0, 0))]
)
def test_rgb_to_hsv(spark, rgb, hsv):
    assert tuple(one(spark, color.rgb_to_hsv(*[F.lit(v) for v in rgb]))[0]) == hsv


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        nxt = [0]
        for j, y in enumerate(b):
            nxt.append(row[j] + 1 if x == y else max(nxt[-1], row[j + 1]))
        row = nxt
    return row[-1]


def test_indel_ratio_agrees_with_brute_force(spark):
    import random

    rng = random.Random(5)
    words = ["".join(rng.choice("kilé击") for _ in range(rng.randint(0, 9))) for _ in range(150)] + ["kiill", "health", "击杀", "kil" * 50, "lik击" * 70]
    kws = ["KILL", "击杀", "li", "k" * 30 + "il" * 25, "kilé击" * 20, "l" * 61, "ik" * 61, "il" * 61 + "k"]
    df = spark.createDataFrame([(w,) for w in words], ["w"])
    fast = df.select("w", F.explode(text.keywords_column(kws)).alias("k")).select(
        "w",
        F.col("k.norm").alias("norm"),
        similarity.keyword_ratio(F.col("w"), F.col("k")).alias("fast"),
        similarity.indel_ratio(F.col("w"), F.col("k.norm")).alias("plain"),
        similarity.ratio_ceiling(F.col("w"), F.col("k")).alias("top"),
    )
    for r in fast.collect():
        want = 2 * lcs(r.w, r.norm) / (len(r.w) + len(r.norm))
        assert r.fast == pytest.approx(want) and r.plain == pytest.approx(want) and r.top >= want - 1e-12


def test_matching_blocks_ratio(spark):
    pairs = [("Kill", "kiLL"), ("", "kill"), (None, "kill"), ("killed", "skill"), ("abxcd", "abcd")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r.r for r in df.select(similarity.matching_blocks_ratio("a", "b").alias("r")).collect()]
    assert got == [SequenceMatcher(None, a.lower(), b.lower()).ratio() if a and b else 0.0 for a, b in pairs]


def test_fusion_drops_inactive_weights(spark):
    w = {"ocr": 0.4, "template": 0.3, "color": 0.2, "yolo": 0.1}
    sig = fusion.signals(0.0, 1.0, 1.0, 1.0)
    zero = {k: 0.0 for k in w}
    row = one(
        spark,
        fusion.weighted_confidence(sig, w),
        fusion.weighted_confidence(sig, w, ocr_active=False),
        fusion.weighted_confidence(sig, zero),
        fusion.ocr_confidence(F.lit(95.0)),
        fusion.ocr_confidence(F.lit(0.95)),
        fusion.color_signal(F.lit(0.5)),
    )
    assert row[0] == pytest.approx(0.6) and row[1] == pytest.approx(1.0) and row[2] == 0.0
    assert tuple(row[3:]) == (0.95, 0.95, 1.0)


def test_booleans(spark):
    sig = fusion.signals(ocr=0.2, template=0.75, color=0.9, yolo=0.0)
    null = F.lit(None).cast("double")
    b = lambda pct, floor, loaded: fusion.booleans(sig, 0.2, pct, floor, loaded)
    row = one(spark, b(F.lit(0.1), 0.7, True), b(null, 0.8, True), b(F.lit(0.2), 0.7, False), fusion.booleans(fusion.signals(), 0.2, null, 0.0, True))
    assert row[0] == {"ocr": True, "yolo": False, "color": False, "template": True}
    assert row[1] == {"ocr": True, "yolo": False, "color": True, "template": False}
    assert row[2]["template"] is False and row[2]["color"] is True
    assert row[3]["template"] is True
