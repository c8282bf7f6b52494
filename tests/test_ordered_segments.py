"""Bucketed scans and merges against plain loops; bucket widths are tiny so that borders matter."""

import random

import pytest
from pyspark.sql import functions as F

from reelspark.operators import clips, segments, timeline
from reelspark.operators.ordered import Run, numbered, running, top_per_key


@pytest.fixture(scope="module")
def events():
    rng = random.Random(11)
    rows = []
    for video in range(60):
        t = 0
        for _ in range(rng.randint(1, 60)):
            t += rng.choice([0, 1, 3, 7, 20, 60, 400])
            rows.append((video, t))
    # one video with a third of all rows, all close together
    rows += [(999, rng.randint(0, 3000)) for _ in range(len(rows) // 2)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def frame(spark, events):
    return spark.createDataFrame([(v, t, i) for i, (v, t) in enumerate(events)], "video_id bigint, ts_ms bigint, seq bigint").cache()


def by_video(rows):
    out = {}
    for video, *rest in rows:
        out.setdefault(video, []).append(tuple(rest))
    return {v: sorted(r) for v, r in out.items()}


def loop_merge(times, pre, post):
    out = []
    for t in sorted(times):
        start, end = max(0, t - pre), t + post
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
            out[-1][2].append(t)
        else:
            out.append([start, end, [t]])
    return [(s, e, len(k), k[0], k[-1]) for s, e, k in out]


@pytest.mark.parametrize("width", [10, 64, 1000, 10**6])
@pytest.mark.parametrize("pre, post", [(0.003, 0.001), (0.02, 0.0), (0.0, 0.03)])
def test_merge_and_sessions_match_the_loop(frame, events, width, pre, post):
    grouped = {v: [t for (t,) in r] for v, r in by_video(events).items()}
    want = sorted((v, *c) for v, ts in grouped.items() for c in loop_merge(ts, round(pre * 1000), round(post * 1000)))
    columns = ["video_id", "start_ms", "end_ms", "kill_count", "first_ts_ms", "last_ts_ms"]
    merged = segments.merge(segments.pad(frame, pre, post), width=width)
    assert sorted(map(tuple, merged.select(columns).collect())) == want
    sessions = segments.merge_sessions(frame, pre, post, width=width)
    # a session cannot see that clipping at zero changes nothing about the order, so the bounds agree too
    assert sorted(map(tuple, sessions.select(columns).collect())) == want


def test_merge_of_uneven_segments(spark):
    rows = [(1, 0, 1000, 5), (1, 10, 20, 15), (1, 999, 1001, 1000), (1, 1002, 1003, 1002), (1, 5000, 9000, 6000), (1, 8999, 9100, 9000), (1, 9101, 9102, 9101)]
    df = spark.createDataFrame(rows, "video_id bigint, start_ms bigint, end_ms bigint, ts_ms bigint")
    for width in (7, 100, 1000, 10**7):
        got = sorted(map(tuple, segments.merge(df, width=width).collect()))
        assert got == [(1, 0, 1001, 3, 5, 1000), (1, 1002, 1003, 1, 1002, 1002), (1, 5000, 9100, 2, 6000, 9000), (1, 9101, 9102, 1, 9101, 9101)]


def test_members_cover_every_event_once(frame, events):
    out = segments.members(segments.pad(frame, 0.003, 0.001), width=16).select("seq", "clip_start_ms", "ts_ms", "video_id").collect()
    assert sorted(r.seq for r in out) == list(range(len(events)))
    grouped = {v: [t for (t,) in r] for v, r in by_video(events).items()}
    bounds = {v: loop_merge(ts, 3, 1) for v, ts in grouped.items()}
    for r in out:
        clip = next(c for c in bounds[r.video_id] if c[0] == r.clip_start_ms)
        assert clip[3] <= r.ts_ms <= clip[4]


def test_streaks_use_consecutive_gaps(frame, events):
    want = []
    for v, rows in by_video(events).items():
        run = []
        for (t,) in rows + [(10**9,)]:
            if run and t - run[-1] > 20:
                if len(run) >= 2:
                    want.append((v, max(0, run[0] - 3), run[-1] + 1, len(run)))
                run = []
            run.append(t)
    got = segments.streaks(frame, 0.02, 0.003, 0.001, min_kills=2, width=50)
    assert sorted(map(tuple, got.select("video_id", "start_ms", "end_ms", "kill_count").collect())) == sorted(want)


def test_documented_examples(spark):
    ev = spark.createDataFrame([(1, 10_000), (1, 11_000), (1, 30_000)], "video_id bigint, ts_ms bigint")
    padded = segments.pad(ev.limit(1), 3, 1).first()
    assert (padded.start_ms, padded.end_ms) == (7000, 11000)
    rows = clips.number(segments.classify(segments.merge(segments.pad(ev, 2, 1)))).orderBy("id").collect()
    assert [(r.id, r.kill_type, r.filename) for r in rows] == [
        (1, "double_kill", "clip_001_double_kill_8s.mp4"),
        (2, "single_kill", "clip_002_single_kill_28s.mp4"),
    ]


@pytest.mark.parametrize(
    "count, span, name",
    [(1, 0, "single_kill"), (2, 10_000, "double_kill"), (2, 10_001, "multiple_kills"), (5, 9000, "penta_kill"), (6, 9000, "multi_kill"), (1, 99_999, "single_kill")],
)
def test_kill_types(spark, count, span, name):
    assert spark.range(1).select(segments.kill_type(F.lit(count), F.lit(span), 10_000)).first()[0] == name


@pytest.mark.parametrize("width", [1, 13, 500, 10**6])
def test_running_matches_the_loop(frame, events, width):
    value = F.when(F.col("seq") % 3 > 0, F.col("seq"))
    runs = {
        "total": Run("sum", value),
        "top": Run("max", value, "through"),
        "low": Run("min", value, "onward"),
        "prev": Run("last", F.struct("seq", "ts_ms")),
        "seen": Run("last", value, "through"),
        "next": Run("last", value, "onward"),
    }
    got = {r.seq: r for r in running(frame, ["video_id"], "ts_ms", runs, width=width, tie=["seq"]).collect()}
    assert len(got) == len(events)
    groups = {}
    for seq, (v, t) in enumerate(events):
        groups.setdefault(v, []).append((t, seq))
    for rows in groups.values():
        rows.sort()
        val = [s if s % 3 else None for _, s in rows]
        for i, (t, seq) in enumerate(rows):
            r = got[seq]
            past, upto, rest = [x for x in val[:i] if x is not None], [x for x in val[: i + 1] if x is not None], [x for x in val[i:] if x is not None]
            assert r.total == (sum(past) if past else None)
            assert r.top == (max(upto) if upto else None)
            assert r.low == (min(rest) if rest else None)
            assert (tuple(r.prev) if r.prev else None) == ((rows[i - 1][1], rows[i - 1][0]) if i else None)
            assert r.seen == (upto[-1] if upto else None)
            assert r.next == (rest[0] if rest else None)


def test_numbered_and_top(frame):
    ranks = numbered(frame, ["video_id"], "ts_ms", "n", width=9, tie=["seq"]).groupBy("video_id").agg(F.max("n").alias("m"), F.count_distinct("n").alias("d"), F.count("n").alias("c")).collect()
    assert all(r.m == r.d == r.c for r in ranks)
    top = top_per_key(frame, ["video_id"], [F.col("seq").desc()], 2)
    assert top.groupBy("video_id").count().agg(F.max("count")).first()[0] == 2
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def loop_timeline(durations, wanted):
    out, end = [(None, None, float(durations[0]))], durations[0]
    for prev, cur in zip(durations, durations[1:]):
        trans = min(prev, cur) / 2 if prev < wanted or cur < wanted else wanted
        offset = end - trans
        end = offset + cur
        out.append((float(trans), float(offset), float(end)))
    return out


def test_transitions_match_the_loop(spark):
    rng = random.Random(3)
    videos = {v: [rng.choice([100, 300, 501, 800, 2000]) for _ in range(rng.randint(1, 40))] for v in range(30)}
    videos[77] = [500, 0, 500]
    df = spark.createDataFrame([(v, i + 1, d) for v, ds in videos.items() for i, d in enumerate(ds)], "video_id bigint, id bigint, duration_ms bigint")
    got = {}
    for r in timeline.transitions(df, 500, width=7).collect():
        got.setdefault(r.video_id, {})[r.id] = (r.transition_ms, r.offset_ms, r.edit_end_ms)
        assert r.shortened == (r.transition_ms is not None and r.transition_ms < 500)
    assert 77 not in got
    for v, ds in videos.items():
        if v != 77:
            assert [got[v][i + 1] for i in range(len(ds))] == loop_timeline(ds, 500)
    one = timeline.chunk_durations(df.filter("video_id <> 77"), 4, 500).collect()
    for r in one:
        part = videos[r.video_id][(r.id - 1) * 4 : r.id * 4]
        assert r.duration_ms == loop_timeline(part, 500)[-1][2]


@pytest.mark.parametrize("value, size", [("x", 4), (None, 4), (0, 0), (-3, 0), (1, 2), (7, 7), ("5", 5)])
def test_chunk_size(value, size):
    assert timeline.chunk_size(value) == size


def test_segment_chunks(spark):
    df = spark.createDataFrame([(1, i) for i in range(1, 18)] + [(2, i) for i in range(1, 5)], "video_id bigint, id bigint")
    rows = timeline.segment_chunks(df, 4).collect()
    levels = {v: max(r.level for r in rows if r.video_id == v) for v in (1, 2)}
    assert levels == {1: 3, 2: 1}
    assert {r.chunk for r in rows if r.video_id == 1 and r.level == 2} == {0, 1}


def test_multi_video_order(spark):
    cl = spark.createDataFrame([(v, i) for v, n in ((5, 3), (6, 2), (7, 4)) for i in range(1, n + 1)], "video_id bigint, id bigint")
    rs = spark.createDataFrame([(0, 7, 0, True), (0, 5, 1, False), (0, 6, 2, True), (1, 5, 0, True)], "batch_id bigint, video_id bigint, input_order bigint, success boolean")
    skip = sorted((r.batch_id, r.position, r.video_id, r.id) for r in timeline.multi_video_order(cl, rs, "skip", width=1).collect())
    assert [x[2:] for x in skip if x[0] == 0] == [(7, 1), (7, 2), (7, 3), (7, 4), (6, 1), (6, 2)]
    stop = timeline.multi_video_order(cl, rs, "stop").select("batch_id").distinct().collect()
    assert [r.batch_id for r in stop] == [1]
