"""Queries on single texts: language, token counts, quality, url rules, pseudonyms."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import functions as F

from reelspark.llm import language, pseudonyms, quality, token_cache, urls
from reelspark.llm.common import remainder, shared_folder, table
from reelspark.llm.registry import query


@query("op1_language")
def op1_language(spark, sf):
    docs = table(spark, sf, "documents")
    part = remainder(F.col("doc_id"), 3)
    profiles = language.learn(docs.filter(part != 1))
    return docs.select(
        "doc_id", F.coalesce(part == 1, F.lit(False)).alias("held_out"), language.identify(F.col("text"), profiles, spark).alias("p")
    ).select("doc_id", "held_out", "p.lang_pred", "p.score", "p.n_grams")


@query("op4_token_counts")
def op4_token_counts(spark, sf):
    # A cache of its own for each call, so that every call shows the whole work.
    cache = f"{shared_folder(spark)}/token-cache-{uuid.uuid4().hex}"
    found = token_cache.count_tokens(table(spark, sf, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), cache)
    return found.select("row.doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


@query("op5_quality")
def op5_quality(spark, sf):
    docs = table(spark, sf, "documents")
    part = remainder(F.col("doc_id"), 5)
    model = quality.learn(docs, table(spark, sf, "labels").filter(part != 0))
    scored = docs.select("doc_id", F.coalesce(part == 0, F.lit(False)).alias("held_out"), quality.score(F.col("text"), model, spark).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


#: Verdict, host and start of the path.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


@query("op6_url_filter")
def op6_url_filter(spark, sf):
    return urls.judge(table(spark, sf, "pages"), RULES)


@query("op8_pseudonyms")
def op8_pseudonyms(spark, sf):
    found = pseudonyms.pseudonymise(table(spark, sf, "documents").select("doc_id", "text"), "a key that production draws from its secret store")
    return found.select("row.doc_id", "text", F.size("found").cast("long").alias("n_found"), F.array_join("found.kind", ",").alias("kinds"))
