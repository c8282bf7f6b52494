"""All registered queries."""

from reelspark.plans import align_queries, clip_queries, config_queries, detect_queries, ops_queries, source_queries
from reelspark.plans.inputs import ORACLE, QUERIES

__all__ = [
    "ORACLE",
    "QUERIES",
    "align_queries",
    "clip_queries",
    "config_queries",
    "detect_queries",
    "ops_queries",
    "source_queries",
]
