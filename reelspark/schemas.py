"""Schemas of the documents read from outside."""

from __future__ import annotations

EVENT_DOC = (
    "timestamp_ms STRING, type STRING, confidence STRING, recorded_at STRING, "
    "signals MAP<STRING,DOUBLE>, meta STRUCT<signals:MAP<STRING,DOUBLE>,frame_path:STRING>"
)
CLIP_DOC = (
    "id BIGINT, path STRING, filename STRING, start_ms BIGINT, end_ms BIGINT, kill_count BIGINT, kill_type STRING, "
    "start DOUBLE, end DOUBLE, output_path STRING, source_video STRING"
)
PROBE_DOC = (
    "STRUCT<streams:ARRAY<STRUCT<codec_type:STRING,codec_name:STRING,width:INT,height:INT,r_frame_rate:STRING,"
    "nb_frames:STRING,sample_rate:STRING,channels:STRING>>,"
    "format:STRUCT<duration:STRING,bit_rate:STRING,format_name:STRING>>"
)
CHECKPOINT_DOC = (
    "STRUCT<checkpoint_version:INT,video_path:STRING,fingerprints:MAP<STRING,STRING>,"
    "stages:MAP<STRING,STRUCT<status:STRING,duration:DOUBLE>>,"
    "results:STRUCT<frames:ARRAY<STRING>,detection_json:STRING,clips:ARRAY<STRUCT<path:STRING,output_path:STRING>>,"
    "joined_video:STRING,final_video:STRING,report_path:STRING>,temp_dir:STRING,timestamp:STRING>"
)
PROFILE_DOC = "MAP<STRING,STRUCT<count:BIGINT,total:DOUBLE,avg:DOUBLE,min:DOUBLE,max:DOUBLE,step_name:STRING>>"
