import json

import pytest
from pyspark.sql import functions as F

from reelspark.operators import clips, report, segments
from reelspark.sources import ingest, sinks


def test_inventory_of_real_files(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    for folder, names in ((a, ["z.mp4", "Y.MKV", "x.Mp4", "n.txt", "w.avi"]), (b, ["q.webm", "B.mov"])):
        folder.mkdir()
        for n in names:
            (folder / n).write_bytes(b"x" * 2000)
    roots = [str(b), str(a), f"{a}/*.avi", f"{b}/q.webm"]
    out = ingest.video_inventory(spark, roots)
    names = [r.path.rsplit("/", 1)[-1] for r in out.orderBy("seq").collect()]
    assert names == ["B.mov", "z.mp4", "w.avi", "Y.MKV", "q.webm"]
    assert [r.seq for r in out.orderBy("seq").collect()] == [1, 2, 3, 4, 5]
    catalog = ingest.video_inventory(spark, [str(a), str(b)], order="name").collect()
    assert [r.name for r in catalog] == ["B.mov", "q.webm", "w.avi", "x.Mp4", "Y.MKV", "z.mp4"] and catalog[0].size_formatted == "2.0 KB"
    plan = ingest.list_files(spark, [str(a)])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" not in plan or "content" not in plan.split("ReadSchema")[1]


def test_probe_documents(spark):
    docs = [
        (1, {"streams": [{"codec_type": "audio", "codec_name": "aac", "sample_rate": "44100", "channels": 2}, {"codec_type": "video", "width": 640, "height": 480, "r_frame_rate": "30000/1001", "nb_frames": "N/A"}], "format": {"duration": "9.5", "bit_rate": "100"}}),
        (2, {"streams": [{"codec_type": "audio"}]}),
        (3, "{oops"),
        (4, {}),
    ]
    df = spark.createDataFrame([(i, d if isinstance(d, str) else json.dumps(d)) for i, d in docs], "video_id int, json string")
    videos, rejected = ingest.read_video_probe(df)
    v = videos.first()
    assert (v.video_id, v.width, v.fps, v.duration_s, v.bitrate, v.codec, v.total_frames) == (1, 640, 30000 / 1001, 9.5, 100, "unknown", None)
    assert {r.video_id: r.reason for r in rejected.collect()} == {2: "no video stream", 3: "unparsable document", 4: "no video stream"}
    audio = {r.video_id: (r.audio, r.channels) for r in ingest.read_audio_probe(df).collect()}
    assert audio == {1: ("has_audio", 2), 2: ("has_audio", None), 3: ("probe_failed", None), 4: ("no_audio", None)}


def test_logs_packets_and_grids(spark):
    lines = spark.createDataFrame([(1, "[x showinfo @ 0] n:   3 pts: 9 pts_time:1.0005 x"), (1, "n:4 pts_time: 2"), (2, "frame=1")], "video_id int, line string")
    got = [(r.n, r.ts_ms) for r in ingest.parse_frame_log(lines, 10).orderBy("n").collect()]
    assert got == [(3, 1010), (4, 2010)]
    assert [r.video_id for r in ingest.logs_without_frames(lines, ingest.parse_frame_log(lines)).collect()] == [2]
    packets = spark.createDataFrame([(1, s) for s in ("1.5,K__", "2.5,___", "N/A,K__", "", "3.25", " 4.0 , _K_ ")], "video_id int, line string")
    assert sorted(r.keyframe_ms for r in ingest.read_keyframes(packets).collect()) == [1500, 4000]
    videos = spark.createDataFrame([(1, 3.0), (2, 2.001), (3, 0.0)], "video_id int, duration_s double")
    grid = {}
    for r in ingest.frame_grid(videos, 1000).collect():
        grid.setdefault(r.video_id, []).append(r.ts_ms)
    assert grid == {1: [0, 1000, 2000], 2: [0, 1000, 2000]}


def test_event_documents_and_round_trip(spark, tmp_path):
    (tmp_path / "old").mkdir()
    docs = [{"timestamp_ms": "1200", "confidence": "0.75", "meta": {"signals": {"ocr": 0.5}}}, {"type": "ace", "signals": {"yolo": 1.0}}]
    (tmp_path / "old" / "detections.json").write_text(json.dumps(docs))
    old = ingest.read_events(spark, str(tmp_path / "old")).orderBy("ts_ms").collect()
    assert [(r.ts_ms, r.confidence, r.type, r.signals) for r in old] == [(0, 0.0, "ace", {"yolo": 1.0}), (1200, 0.75, "kill", {"ocr": 0.5})]
    ev = spark.createDataFrame([(7, 10, 0.12345, None, {"ocr": 1.0}), (8, 20, 0.5, "ace", {})], "video_id int, ts_ms bigint, confidence double, type string, signals map<string,double>")
    sinks.write_events(ev, str(tmp_path / "new"))
    new = ingest.read_events(spark, str(tmp_path / "new"), documents=False).orderBy("ts_ms").collect()
    assert [(r.ts_ms, r.confidence, r.type, r.signals, r.frame_path) for r in new] == [(10, 0.123, "kill", {"ocr": 1.0}, ""), (20, 0.5, "ace", {}, "")]


@pytest.fixture
def numbered(spark):
    ev = spark.createDataFrame([(1, 10_000), (1, 11_000), (1, 30_000)], "video_id int, ts_ms bigint")
    return clips.number(segments.classify(segments.merge(segments.pad(ev))))


def test_clip_metadata_round_trip(spark, tmp_path, numbered):
    sinks.write_clips(numbered, str(tmp_path / "clips"), "out")
    valid, rejected = ingest.read_clip_metadata(spark, str(tmp_path / "clips"), documents=False)
    rows = valid.orderBy("id").collect()
    assert [(r.id, r.clip_path, r.start_ms, r.kill_count) for r in rows] == [(1, "out/clip_001_double_kill_7s.mp4", 7000, 2), (2, "out/clip_002_single_kill_27s.mp4", 27000, 1)]
    assert rejected.count() == 0
    (tmp_path / "m.json").write_text(json.dumps([{"id": 5, "path": ""}, {"id": 6, "output_path": "x.mp4"}]))
    valid, rejected = ingest.read_clip_metadata(spark, str(tmp_path / "m.json"))
    assert [r.clip_path for r in valid.collect()] == ["x.mp4"] and [r.error for r in rejected.collect()] == ["clip 5 has no path"]
    with pytest.raises(Exception, match="has no path"):
        ingest.read_clip_metadata(spark, str(tmp_path / "m.json"), strict=True)[0].collect()


def test_reports(spark, tmp_path, numbered):
    info = spark.createDataFrame(
        [(1, None, "a.mp4", None, None, "1920x1080", 60.0, None, "125"), (2, "b.mp4", None, 1280, 720, None, 30.0, "00:00:09", None)],
        "video_id int, video_path string, path string, width int, height int, resolution string, fps double, duration_str string, duration string",
    )
    cfg = spark.createDataFrame([(1, 0, "detection: {}"), (1, 1, "global: {}")], "video_id int, line_no int, text string")
    sinks.write_reports(report.lines(report.video_stats(info), numbered, config=cfg), str(tmp_path / "r"))
    docs = {}
    for f in sorted((tmp_path / "r").rglob("part-*.txt")):
        docs.setdefault(f.parent.name, []).append(f.read_text())
    one, two = "".join(docs["video_id=1"]), "".join(docs["video_id=2"])
    assert "- **Resolution**: 1920x1080\n" in one and "- **Duration**: 00:02:05\n" in one and "- **Total Kills Detected**: 3\n" in one
    assert "### Breakdown by Kill Type\n- Double Kill: 1\n- Single Kill: 1\n\n## 3." in one
    assert "| 1 | 00:00:07.000 | 00:00:12.000 | 2 | Double Kill |\n| 2 |" in one
    assert "```yaml\ndetection: {}\nglobal: {}\n```" in one
    assert "No kills detected" in two and "### Breakdown" not in two


def test_profiles_history_and_checkpoints(spark, tmp_path):
    (tmp_path / "prof").mkdir()
    (tmp_path / "prof" / "a.json").write_text(json.dumps({"ocr": {"count": 2, "total": 3.0, "avg": 1.5, "min": 1.0, "max": 2.0, "step_name": "ocr"}}, indent=2))
    assert [(r.step, r["count"], r.avg) for r in ingest.read_profiles(spark, str(tmp_path / "prof")).collect()] == [("ocr", 2, 1.5)]
    rows = spark.createDataFrame([(1, 2.0)], "video_id int, x double")
    for run in ("a", "b", "a"):
        sinks.write_profile(rows, str(tmp_path / "p"), run)
    assert spark.read.json(str(tmp_path / "p")).count() == 2
    for ts in ("20240101_000000", "20240102_000000", "20240101_000000"):
        sinks.append_history(rows, rows, ts, str(tmp_path / "h"))
    assert spark.read.json(str(tmp_path / "h" / "results")).select("run_ts").distinct().count() == 2 == spark.read.json(str(tmp_path / "h" / "results")).count()
    ck = tmp_path / "ck"
    ck.mkdir()
    good = {"checkpoint_version": 2, "video_path": "v", "stages": {"frames": {"status": "SUCCESS", "duration": 1}}, "results": {"frames": ["f"], "clips": [{"output_path": "c"}]}}
    (ck / "a.json").write_text(json.dumps(good, indent=1))
    (ck / "b.json").write_text("{broken")
    (ck / "b.json.bak").write_text(json.dumps({**good, "checkpoint_version": 3}))
    (ck / "c.json").write_text("{broken")
    out = {r.checkpoint_path.rsplit("/", 1)[-1]: r for r in ingest.read_checkpoints(spark, str(ck)).collect()}
    assert set(out) == {"a.json", "b.json"} and out["b.json"].from_backup and out["b.json"].version == 3
    assert out["a.json"].stages == {"frames": "SUCCESS"} and out["a.json"].clips == ["c"]
