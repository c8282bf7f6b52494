"""Sums along linked lists, found in a distributed way.

Every 32nd link on average, chosen by hash, is a splitter. All links jump over their successors at once, each time
doubling their reach and adding up what they pass, until each points to a splitter or to its list's end. The splitters then form
lists of their own, a 32nd of the size, which are summed up alike; what lies before them adds theirs. The number of rounds grows with
the logarithm of the longest gap, not of the list, and every level reads a 32nd of the one before; at most ``ONE_TASK`` links are
left to a single task. Each successor has one predecessor, so no key of these joins has many rows.

Each round is stored, so a lost executor costs one round. Links that lie on a cycle have no end and get no row; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.llm.common import stored

ONE_TASK = 1 << 14
APART = 32
#: A link (c, s), the one after it (nc, ns; null at the end) and its two weights.
LINK = ("c", "s", "nc", "ns", "a", "b")
SUMS = "c long, s long, a long, b long"


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of at most ``ONE_TASK`` links, from each end backwards."""
    rows = [row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in LINK))]
    before: dict = {}
    for row in rows:
        before.setdefault(row[2:4], []).append(row)
    out, waiting = [], [(row, 0, 0) for row in before.get((None, None), [])]
    while waiting:
        (c, s, _, _, a, b), x, y = waiting.pop()
        out.append((c, s, a + x, b + y))
        waiting += [(row, a + x, b + y) for row in before.get((c, s), [])]
    columns = list(zip(*out)) or [(), (), (), ()]
    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["c", "s", "a", "b"])


def suffix_sums(links: DataFrame, level: int = 0, apart: int = APART, one_task: int = ONE_TASK) -> DataFrame:
    """(c, s, a, b) of every link: its own weights and those of all links after it."""

    def splitter(c: str, s: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(level), c, s), F.lit(apart)) == 0

    def marked(rows: DataFrame) -> DataFrame:
        return stored(rows.select(*LINK, (F.col("nc").isNull() | splitter("nc", "ns")).alias("done")), "links")

    links = marked(links)
    if links.count() <= one_task:
        return links.select(*LINK).repartition(1).mapInArrow(_walk, SUMS)
    while not links.filter(~F.col("done")).isEmpty():
        after = links.select(F.col("c").alias("nc"), F.col("s").alias("ns"), *[F.col(x).alias(f"_{x}") for x in ("nc", "ns", "a", "b")])
        jumped = links.filter(~F.col("done")).join(after, ["nc", "ns"])
        jumped = jumped.select("c", "s", F.col("_nc").alias("nc"), F.col("_ns").alias("ns"), (F.col("a") + F.col("_a")).alias("a"), (F.col("b") + F.col("_b")).alias("b"))
        links = marked(links.filter("done").select(*LINK).unionByName(jumped))
    sums = stored(suffix_sums(links.filter(splitter("c", "s")).select(*LINK), level + 1, apart, one_task), "sums")
    beyond = sums.select(F.col("c").alias("nc"), F.col("s").alias("ns"), F.col("a").alias("_a"), F.col("b").alias("_b"))
    between = links.filter(~splitter("c", "s")).join(beyond, ["nc", "ns"], "left")
    total = [(F.col(x) + F.coalesce(f"_{x}", F.lit(0))).alias(x) for x in ("a", "b")]
    return sums.unionByName(between.select("c", "s", *total))
