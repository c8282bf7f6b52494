"""Token counts through a digest cache.

A row's content is named by the SHA-256 of its text (null as empty; the tokenizer is byte-exact, so that is all the
normalisation there is), a tokenizer by the SHA-256 of its file. Counts are kept in a table (digest, version,
n_tokens); only distinct contents that it lacks are encoded, and their counts are appended.

Copies shrink to one text for each task before the shuffle. Defined results: null and empty texts have 0 tokens; repeated
rows each get their count; a doc_id may be null; other columns pass through; empty tables give no rows and append none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelspark.llm.tokenizing import groups, pieces

SCHEMA = "digest binary, version string, n_tokens long"


def version_of(path: str) -> str:
    with open(path, "rb") as file:
        return hashlib.file_digest(file, "sha256").hexdigest()


def open_cache(spark: SparkSession, cache: str) -> DataFrame:
    """The cache table at ``cache``, made empty if there is none."""
    spark.createDataFrame([], SCHEMA).write.mode("append").parquet(cache)
    return spark.read.schema(SCHEMA).parquet(cache)


def misses(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(digest, text) of the distinct contents of ``docs`` (digest, text) that ``known`` (digest) lacks."""
    return docs.groupBy("digest").agg(F.first("text").alias("text")).join(known, "digest", "left_anti")


def count_tokens(docs: DataFrame, path: str, cache: str) -> DataFrame:
    """The columns of ``docs`` as struct ``row`` with n_bytes and n_tokens; new counts are appended to ``cache``."""
    spark, version = docs.sparkSession, version_of(path)

    @F.pandas_udf(T.LongType())
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = pieces(path, True)
        for batch in batches:
            counts = [n for part in groups(batch.tolist()) for n in encoder.encode(part)]
            yield pd.Series(counts, dtype="int64")

    text = F.coalesce(docs["text"], F.lit(""))
    digest = F.unhex(F.sha2(text, 256))
    known = open_cache(spark, cache).filter(F.col("version") == version).select("digest")
    new = misses(docs.select(digest.alias("digest"), text.alias("text")), known)
    new.select("digest", F.lit(version).alias("version"), encoded("text").alias("n_tokens")).write.mode("append").parquet(cache)
    counts = spark.read.schema(SCHEMA).parquet(cache).filter(F.col("version") == version).select("digest", "n_tokens").dropDuplicates(["digest"])
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"), digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes")
    )
    return rows.join(counts, "digest").select("row", "n_bytes", "n_tokens")
