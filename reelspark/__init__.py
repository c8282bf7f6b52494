"""Highlight-event analytics on Spark: detection, clips, timelines, lineage and telemetry as DataFrames."""
