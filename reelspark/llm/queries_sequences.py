"""Queries on conversations and on piece ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from reelspark.llm import piece_merges, prefix_trie, repair
from reelspark.llm.common import spread_join, stored, table
from reelspark.llm.registry import query


@query("op13_piece_ids")
def op13_piece_ids(spark, sf):
    coded = piece_merges.round_trip(F.col("text"), public_tokenizers.path("piece_bpe_32k.model"))
    found = table(spark, sf, "documents").select("doc_id", coded.alias("coded"))
    return found.select(
        "doc_id",
        F.size("coded.ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("coded.ids", ","), 256).alias("ids_sha256"),
        F.sha2("coded.decoded", 256).alias("decoded_sha256"),
    )


def damaged(turns):
    """Rows of ``conversations`` with faults put in by the checksum of their place; which rows there are depends on nothing else."""
    space = F.lit(" ")
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    place = F.concat(repair.as_text(F.col("conv_id")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    fault = F.crc32(place.cast("binary")) % 20
    return (
        turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), fault.alias("fault"))
        .filter("fault <> 0")
        .select(
            "conv_id",
            "turn",
            F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
            F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
        )
        .drop("copy")
    )


#: SHA-256 of no text.
NOTHING = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


@query("op12_conversation_repair")
def op12_conversation_repair(spark, sf):
    turns = table(spark, sf, "conversations")
    found = repair.repair(damaged(turns)).withColumn("cid", repair.as_text(F.col("conv_id"))).drop("conv_id")
    every = turns.groupBy("conv_id").agg(F.lit(1).alias("one")).select("conv_id", repair.as_text(F.col("conv_id")).alias("cid"))
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return every.join(found, "cid", "left").select(
        "conv_id",
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(NOTHING)).alias("repaired_sha256"),
    )


#: Conversations of a family begin with turns of its first one, fewer than this.
HEAD = 4


def rebuilt(turns):
    """Numbered turns of conversations that begin with the first turns of their family's first, and all conversations."""
    own = stored(prefix_trie.numbered_turns(turns), "turns")
    turn = F.struct("pos", *prefix_trie.TURN)
    heads = own.filter(F.col("pos") < HEAD - 1).groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(turn)).alias("head"))
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD
    family = own.groupBy("conv_id").agg(F.lit(1).alias("one")).select("conv_id", (F.col("conv_id") - F.col("conv_id") % 20).alias("base"), taken.alias("h"))
    head = F.filter(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), lambda t: t["pos"] < F.col("h"))
    members = stored(family.join(heads, "base", "left").select("conv_id", "h", head.alias("head")), "members")
    begun = members.select("conv_id", F.inline("head"))
    rest = spread_join(own, members.select("conv_id", "h", F.size("head").alias("m")), ["conv_id"]).filter(F.col("pos") >= F.col("h"))
    moved = rest.withColumn("pos", F.col("pos") - F.col("h") + F.col("m")).drop("h", "m")
    return begun.unionByName(moved), members.select("conv_id")


@query("op11_prefix_trie")
def op11_prefix_trie(spark, sf):
    return prefix_trie.build(*rebuilt(table(spark, sf, "conversations")))
