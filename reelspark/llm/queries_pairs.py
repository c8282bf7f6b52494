"""Queries on duplicates, contamination, nearest codes and packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from reelspark.llm import decontam, hamming, lines, packing, simhash
from reelspark.llm.common import table
from reelspark.llm.registry import query


@query("op10_simhash")
def op10_simhash(spark, sf):
    found = simhash.near_duplicates(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


@query("op2_decontamination")
def op2_decontamination(spark, sf):
    found = decontam.judge(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


@query("op9_line_dedup")
def op9_line_dedup(spark, sf):
    found = lines.dedup(table(spark, sf, "documents").select("doc_id", "text"), lines.ANY_WORDS)
    return found.select("row.doc_id", "row.text", "n_lines", "n_removed", "n_near", "emptied")


#: The id that ends each document in packed sequences.
END_ID = 2


@query("op7_packing")
def op7_packing(spark, sf):
    found = packing.pack(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return found.drop("loss_tokens")


@query(
    "op3_nearest_codes",
    """
    WITH coded AS (
      SELECT DISTINCT vec_id, list_reduce(list_prepend(0::UBIGINT, list_transform(range(64), lambda i:
               CASE WHEN embedding[i + 1] > 0 THEN 1::UBIGINT << i::UBIGINT ELSE 0::UBIGINT END)), lambda a, b: a | b) AS code
      FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) = 64),
    met AS (
      SELECT q.vec_id AS query_id, r.vec_id AS id, bit_count(xor(q.code, r.code)) AS distance
      FROM coded q, coded r WHERE q.vec_id % 20 = 0)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, id, CAST(distance AS INTEGER) AS distance
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM met) WHERE rank <= 10
    """,
)
def op3_nearest_codes(spark, sf):
    return hamming.search(table(spark, sf, "embeddings"), k=10, every=20)
