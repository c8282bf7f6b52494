"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a checked table that may travel to every task; its rows are a few numbers each, so about 50 MB at most.
BROADCAST_ROWS = 500_000

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``, else one inside the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return (named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared").rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it from there: cuts lineage, survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a *stored* table for broadcast if its row count is proven small; beyond that it joins by shuffle."""
    return F.broadcast(df) if df.count() <= max_rows else df


#: Most keys that ``spread_join`` treats apart.
HOT_KEYS = 20_000


def spread_join(rows: DataFrame, lookup: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined to ``lookup``, which has at most one short row for a key, however many rows of ``rows`` share a key.

    Keys are counted first (combined before the shuffle). A key with over a ``HOT_KEYS``-th of all rows is met where its rows are: there are
    fewer than ``HOT_KEYS`` such keys whatever the table, so their rows of ``lookup`` travel. All others join by shuffle.
    Null keys match nothing. ``rows`` is read twice: store it first if it is dear.
    """
    counts = stored(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")), "keys")
    total = counts.agg(F.sum("__n")).first()[0] or 0
    hot = counts.filter(F.col("__n") > max(total / HOT_KEYS, 100)).select(*keys, F.lit(True).alias("__hot"))
    marked = rows.join(F.broadcast(hot), keys, "left")
    few = lookup.join(F.broadcast(hot.drop("__hot")), keys, "left_semi")
    apart = marked.filter("__hot").drop("__hot").join(F.broadcast(few), keys, how)
    return marked.filter("__hot is null").drop("__hot").join(lookup, keys, how).unionByName(apart)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, all other characters untouched; plain ASCII, where ``lower`` does the same, takes the faster function."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def text_key(text: Column) -> tuple[Column, Column]:
    """128 bits in two longs that stand for a text (null as empty)."""
    text = F.coalesce(text, F.lit(""))
    return F.xxhash64(text), F.xxhash64(F.lit(7), text)


def remainder(doc_id: Column, mod: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % mod
