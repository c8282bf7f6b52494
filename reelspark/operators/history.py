"""Retention of history files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.operators.ordered import top_per_key


def retention(
    files: DataFrame, now: Column, keep_days: float = 30, max_files: int = 100, keys=("dir",)
) -> DataFrame:
    """Verdict per history file: ``expired`` by age, ``excess`` beyond the newest ``max_files``, else ``keep``.

    ``files(dir, name, mtime)``; only names starting with config_ or results_ take part. The newest files come
    from a limited rank and only the cutoff is joined back, so a huge directory is never one sorted group.
    """
    keys = list(keys)
    mine = files.filter(F.col("name").startswith("config_") | F.col("name").startswith("results_"))
    age = (F.unix_micros(now) - F.unix_micros(F.col("mtime").cast("timestamp"))) / 86_400_000_000
    aged = mine.withColumns({"age_days": age, "expired": age > keep_days})
    fresh = aged.filter(~F.col("expired"))
    if max_files <= 0:
        excess = F.lit(True)
        judged = aged
    else:
        newest = top_per_key(fresh.select(*keys, "mtime", "name"), keys, [F.col("mtime").desc(), F.col("name").desc()], max_files)
        cutoff = newest.groupBy(*keys).agg(F.min(F.struct("mtime", "name")).alias("cutoff"))
        judged = aged.join(cutoff, keys, "left")
        excess = F.struct("mtime", "name") < F.col("cutoff")
    verdict = F.when(F.col("expired"), "expired").when(excess, "excess").otherwise("keep")
    return judged.select(*keys, "name", "mtime", "age_days", verdict.alias("verdict"))
