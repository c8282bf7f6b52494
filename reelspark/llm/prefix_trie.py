"""The trie of conversation prefixes, with totals of subtrees by the Euler-tour technique.

A node is a distinct sequence of first turns. It is named by 128 bits: the exclusive or, over its turns, of digests of (place, turn),
which is a running value and so needs no walk along a conversation; a long conversation is cut into stretches like any axis.
Nodes are one aggregation of all prefixes (combined before the shuffle). The smallest member and the depth name a node, too.

For totals of subtrees the edges become a tour: each node is an arc that enters it and one that leaves it. An arc that enters goes on to
the first child, or leaves if there is none; one that leaves goes on to the next sibling (found by sorting all siblings by range: a
node's children may fill many partitions), or leaves the parent. The tour is ranked by ``list_ranking``; what lies between a node's two
arcs is its subtree, so leaves and savings are differences of sums at these places.

Defined results: null roles and texts are empty; rows of one turn go by role, then by a digest of the text; turns are numbered from 0
before anything else, so gaps and repeated turns are turns like others; a conversation without turns ends at the root; rows without
conv_id belong to no conversation and are left out; an empty table has no nodes, not even a root. Texts are hashed where they
are read and travel no further. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.llm.common import spread_join, stored
from reelspark.llm.group_digests import digests
from reelspark.llm.list_ranking import suffix_sums
from reelspark.operators.ordered import BUCKET_ROWS, COUNT_WIDTH, Run, numbered, running

WORDS = r"[^\x20\x09-\x0D]+"
#: What stands for a turn.
TURN = ("k1", "k2", "words")


def numbered_turns(turns: DataFrame, rows: int = BUCKET_ROWS) -> DataFrame:
    """(conv_id, pos, k1, k2, words): each turn's place in its conversation from 0, its digests and its number of words."""
    role, text = F.coalesce(turns["role"], F.lit("")), F.coalesce(turns["text"], F.lit(""))
    keyed = turns.select(
        turns["conv_id"].cast("long").alias("conv_id"),
        turns["turn"],
        role.alias("role"),
        F.xxhash64(role, text).alias("k1"),
        F.xxhash64(F.lit(7), role, text).alias("k2"),
        F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words"),
    ).filter("conv_id is not null")
    placed = numbered(keyed, ["conv_id"], "turn", "n", rows=rows, tie=["role", "k1", "k2"])
    return placed.select("conv_id", (F.col("n") - 1).alias("pos"), *TURN)


def _prefixes(turns: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """(conv_id, depth, x1, x2, p1, p2, words): every prefix of every conversation, with the digests of the one before it."""
    own = {f"o{i}": F.xxhash64("pos", f"k{i}") for i in (1, 2)}
    placed = turns.withColumns(own)
    known = running(placed, ["conv_id"], "pos", {f"x{i}": Run("bit_xor", F.col(f"o{i}"), "through") for i in (1, 2)}, width=width)
    before = [F.col(f"x{i}").bitwiseXOR(F.col(f"o{i}")).alias(f"p{i}") for i in (1, 2)]
    nothing, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = members.select("conv_id", nothing.alias("depth"), nothing.alias("x1"), nothing.alias("x2"), none.alias("p1"), none.alias("p2"), nothing.alias("words"))
    return known.select("conv_id", (F.col("pos") + 1).alias("depth"), "x1", "x2", *before, "words").unionByName(root)


def _tour(nodes: DataFrame) -> DataFrame:
    """Arcs (c, s, next c, next s, leaves, saved) of nodes: s is twice the depth to enter, one more to leave."""

    def arc(s: Column, nc: Column, ns: Column, a: Column, b: Column) -> Column:
        return F.struct(F.col("conv_id").alias("c"), s.alias("s"), nc.alias("nc"), ns.alias("ns"), a.alias("a"), b.alias("b"))

    down, nothing = F.col("depth") * 2, F.lit(0).cast("long")
    leaf, sibling = F.col("n_children") == 0, F.col("sibling").isNotNull()
    enter = arc(down, F.when(leaf, F.col("conv_id")).otherwise(F.col("first_child")), F.when(leaf, down + 1).otherwise(down + 2), leaf.cast("long"), F.col("saved"))
    leave = arc(
        down + 1,
        F.when(sibling, F.col("sibling")).otherwise(F.col("parent_conv_id")),
        F.when(sibling, down).when(F.col("depth") > 0, down - 1),
        nothing,
        nothing,
    )
    return nodes.select(F.explode(F.array(enter, leave)).alias("arc")).select("arc.*")


def build(turns: DataFrame, members: DataFrame, *, width: int = COUNT_WIDTH, rows: int = BUCKET_ROWS, **ranking: int) -> DataFrame:
    """conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node.

    ``turns`` are as from ``numbered_turns``, places without gaps; ``members`` (conv_id) are all conversations, those without turns too.
    """
    prefixes = stored(_prefixes(turns, members, width), "prefixes")
    name = ["depth", "x1", "x2"]
    nodes = stored(
        prefixes.groupBy(*name).agg(
            F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("words").alias("words")
        ),
        "nodes",
    )
    below = nodes.filter("depth > 0").select(F.col("conv_id").alias("child"), (F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2"))
    children = below.groupBy(*name).agg(F.count(F.lit(1)).alias("n_children"), F.min("child").alias("first_child"))
    # A node's children may be a third of all nodes: its own row goes to them, not they to it.
    parents = spread_join(below, nodes.select(*name, F.col("conv_id").alias("parent_conv_id")), name)
    parents = parents.select(F.col("child").alias("conv_id"), (F.col("depth") + 1).alias("depth"), "parent_conv_id")
    saved = ((F.col("n_convs") - 1) * F.col("words")).alias("saved")
    known = nodes.join(children, name, "left").join(parents, ["conv_id", "depth"], "left")
    known = known.select(*name, "conv_id", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "first_child", saved)
    known = stored(running(known, ["parent_conv_id", "depth"], "conv_id", {"sibling": Run("last", F.col("conv_id"), "after")}, rows=rows), "tour")
    sums = suffix_sums(_tour(known), **ranking)
    sign = F.when(F.col("s") % 2 == 0, 1).otherwise(-1)
    subtree = sums.groupBy(F.col("c").alias("conv_id"), F.floor(F.col("s") / 2).alias("depth")).agg(
        F.sum(F.col("a") * sign).alias("n_leaves"), F.sum(F.col("b") * sign).alias("saved_tokens")
    )
    last = prefixes.groupBy("conv_id").agg(F.max(F.struct(*name)).alias("node"))
    label = F.concat_ws(",", *name)
    ends = digests(last.select("conv_id", "node.*").select(label.alias("node"), F.col("conv_id").alias("number")))
    found = known.join(subtree, ["conv_id", "depth"]).withColumn("node", label).join(ends, "node", "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    )
