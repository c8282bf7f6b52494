"""Connected components of a table of links, by alternating star contractions; no group or link list meets in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm.common import stored


def _fingerprint(edges: DataFrame) -> tuple:
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star step (neighbours above a node move to its least neighbour), then one small-star step."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    floor = large.groupBy("a").agg(F.min("b").alias("m"))
    near = large.join(floor, "a")
    return near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(floor.select("a", F.col("m").alias("b"))).filter("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the least node that can be reached.

    Self-links, nulls and repeated links count for nothing; a table without links gives no rows. Each round is stored, so
    a lost executor costs one round; the number of rounds grows with the logarithm of a component's size.
    """
    links = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = stored(links, "links")
    before = _fingerprint(links)
    while before[0]:
        links = stored(_stars(links), "links")
        now = _fingerprint(links)
        if now == before:
            break
        before = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
