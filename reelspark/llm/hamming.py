"""Exact top-k search among 64-bit codes by incremental multi-index hashing.

Codes are cut into m segments and filed under each segment's value. Round r looks up, for every open query, the segment
values that differ from its own in exactly r bits. A code at distance d or less has a segment within d / m bits, so after round
r everything within m * (r + 1) - 1 bits has been seen; a query is closed once its k-th verified distance lies within that.
A pair is verified in one place only: in the round of its closest segment, under the first segment that close.

Distinct codes are searched, not rows: rows with one code share its distance, and of them only the k smallest ids can be
among a query's k nearest, so copies of a vector cost nothing and lose nothing. Ties in distance go to the smaller id.

Defined results: rows without id or without a whole vector are not searched and find nothing; repeated rows count as
one; a query finds itself; fewer than k rows give them all; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspark.llm.common import BROADCAST_ROWS, stored

BITS = 64
#: Segment counts to choose from; a segment should have about as many bits as the number of codes has. Two segments of
#: 32 bits would need up to C(32, r) masks in a plan (906,192 in round 6); four need 12,870 at most, whatever the number of codes.
CHOICES = (8, 4)


def sign_code(vector: Column) -> Column:
    """Bit i of a long tells whether component i is above 0; null unless there are 64 components."""
    bits = F.transform(vector, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(vector) == BITS, F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)))


def segments_for(codes: int) -> int:
    return min(CHOICES, key=lambda m: abs(BITS / m - math.log2(max(codes, 2))))


def _segment(code: Column, j: int, width: int) -> Column:
    return F.shiftrightunsigned(code, width * j).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _masks(width: int, r: int) -> list[int]:
    return [sum(1 << b for b in bits) for bits in combinations(range(width), r)]


def _first_k(rows: DataFrame, key: str, order: list[str], k: int) -> DataFrame:
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.filter(F.col("rank") <= k)


def nearest(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, id, distance) of the k nearest ``rows`` (id, code) of every row of ``queries`` (id, code)."""
    rows = rows.filter("id is not null and code is not null").distinct()
    members = stored(_first_k(rows, "code", ["id"], k).select("code", "id"), "members")
    asked = stored(queries.filter("id is not null and code is not null").distinct(), "asked")
    codes = members.select("code").distinct()
    m = segments_for(codes.count())
    width = BITS // m
    filed = codes.select("code", F.inline(F.array(*[F.struct(F.lit(j).alias("j"), _segment(F.col("code"), j, width).alias("v")) for j in range(m)])))
    filed = stored(filed, "filed")
    # Look-ups far outnumber the queries they come from, so they are never the side that travels.
    filed = F.broadcast(filed) if filed.count() <= BROADCAST_ROWS else filed.hint("merge")
    open_ = asked.select(F.col("code").alias("q")).distinct().withColumn("kth", F.lit(BITS))
    best = None
    for r in range(width + 1):
        new = _verified(_met(open_, filed, m, width, r), m, width, r).filter(F.col("distance") <= F.col("kth"))
        new = new.join(members, "code").select("q", "distance", "id")
        best = new if best is None else best.unionByName(new)
        best = stored(_first_k(best, "q", ["distance", "id"], k).select("q", "distance", "id"), "best")
        reach = best.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far"))
        closed = reach.filter((F.col("n") >= k) & (F.col("far") <= m * (r + 1) - 1))
        full = reach.filter(F.col("n") >= k).select("q", "far")
        left = open_.select("q").join(closed.select("q"), "q", "left_anti").join(full, "q", "left")
        open_ = stored(left.select("q", F.coalesce("far", F.lit(BITS)).alias("kth")), "open")
        if open_.isEmpty():
            break
    ranked = _first_k(best, "q", ["distance", "id"], k)
    found = asked.select(F.col("id").alias("query_id"), F.col("code").alias("q")).join(ranked, "q")
    return found.select("query_id", "rank", "id", "distance")


def _met(open_: DataFrame, filed: DataFrame, m: int, width: int, r: int) -> DataFrame:
    """(q, kth, j, code): codes filed under a value that differs from the query's segment in exactly r bits."""
    looks = F.array(*[F.struct(F.lit(j).alias("j"), _segment(F.col("q"), j, width).alias("own")) for j in range(m)])
    masks = open_.sparkSession.createDataFrame([(x,) for x in _masks(width, r)], "mask long") if r else None
    parts = int(open_.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = open_.repartition(parts, "q").select("q", "kth", F.inline(looks))
    if masks is None:
        asked = asked.withColumn("v", F.col("own"))
    else:
        masks = masks.agg(F.collect_list("mask").alias("masks")).first()["masks"]
        flips = F.transform(F.lit(masks).cast("array<bigint>"), lambda x: F.col("own").bitwiseXOR(x))
        asked = asked.select("q", "kth", "j", F.explode(flips).alias("v"))
    return asked.select("q", "kth", "j", "v").join(filed, ["j", "v"]).select("q", "kth", "j", "code")


def _verified(met: DataFrame, m: int, width: int, r: int) -> DataFrame:
    """(q, kth, code, distance) of the pairs whose first closest segment is the one they met under."""
    apart = F.col("q").bitwiseXOR(F.col("code"))
    own = F.lit(True)
    for j in range(m):
        bits = F.bit_count(_segment(apart, j, width))
        own = own & F.when(F.col("j") > j, bits > r).otherwise(bits >= r)
    return met.filter(own).select("q", "kth", "code", F.bit_count(apart).alias("distance"))


def search(table: DataFrame, k: int, every: int) -> DataFrame:
    """The k nearest rows of ``table`` (vec_id, embedding) for each of its rows whose id ``every`` divides."""
    rows = table.select(table["vec_id"].alias("id"), sign_code(table["embedding"]).alias("code"))
    return nearest(rows, rows.filter(F.col("id") % every == 0), k)
