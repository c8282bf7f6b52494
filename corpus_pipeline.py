"""From raw documents to packed training sequences, one stored table per stage."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from reelspark.llm import decontam, language, lines, packing, simhash
from reelspark.llm.common import remainder, shared_folder, table
from reelspark.llm.queries_pairs import END_ID


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that one language dominates; profiles are learned as in the language query, from the given table."""
    learning = docs.filter(remainder(docs["doc_id"], 3) != 1)
    return language.keep_known(docs, language.learn(learning))


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.keep_lines(docs)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID, with_ids=True, forget=True)


STAGES = [
    ("language", known_language),
    ("line_dedup", distinct_lines),
    ("near_duplicates", distinct_documents),
    ("decontamination", uncontaminated),
    ("packing", packed),
]

#: Mixture inference, fingerprints and token ids are beyond SQL; the tests hold the stages against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's rows are written to the shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
