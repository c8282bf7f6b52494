"""The trie of prefixes against a plain one; list ranking and group digests on their own."""

import hashlib
import math
import random
import re
import zlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelspark.llm import group_digests, list_ranking, prefix_trie
from reelspark.llm.common import HOT_KEYS, spread_join
from reelspark.llm.queries import QUERIES
from reelspark.llm.queries_sequences import rebuilt

TURNS = T.StructType([T.StructField(c, t) for c, t in (("conv_id", T.LongType()), ("turn", T.LongType()), ("role", T.StringType()), ("text", T.StringType()))])
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain_trie(conversations):
    """Rows of the trie of {conv_id: [(role, text), ...]}."""
    members, ends = {}, {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves[node] = sum(leaves[b] for b in below) or 1
        saved[node] = (len(members[node]) - 1) * words + sum(saved[b] for b in below)
    out = set()
    for node, convs in members.items():
        text = ",".join(map(str, sorted(ends.get(node, []))))
        parent = min(members[node[:-1]]) if node else None
        out.add((min(convs), len(node), parent, len(convs), len(children.get(node, [])), leaves[node], saved[node], hashlib.sha256(text.encode()).hexdigest()))
    return out


def plain_rebuilt(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]
    return out


def found(frame):
    rows = [tuple(r[c] for c in COLUMNS) for r in frame.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_plain_trie(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = [tuple(x.values()) for x in pq.read_table(f"{path}/conversations.parquet").select(["conv_id", "turn", "role", "text"]).to_pylist()]
    frame = QUERIES["op11_prefix_trie"](spark, path)
    assert frame.columns == list(COLUMNS)
    assert found(frame) == plain_trie(plain_rebuilt(rows))


def shared_conversations(r, n):
    """Many conversations with common beginnings, repeated conversations, one long one and one with repeated turns."""
    rows = []
    for c in range(0, n):
        for t in range(r.randrange(1, 6)):
            rows.append((c, t, ("user", "assistant")[t % 2], f"word {r.randrange(1 + t)} \t x"))
    rows += [(900, t, "user", f"t{t // 3}") for t in range(700)] + [(920, t, "user", f"t{t // 3}") for t in range(400)]
    return rows


def test_edges_and_small_buckets(spark):
    rows = [
        *shared_conversations(random.Random(3), 300),
        (5000, None, None, None), (5000, 0, "user", None), (5000, 7, "", ""),
        (2**60 + 1, 0, "user", "a"), (2**60 + 3, 0, "user", "a"),
        (None, 0, "user", "nobody's"),
        (6001, 0, "user", "base is absent"), (-7, 3, "user", "below zero"),
        (8000, 0, "user", "b " * 100_000), (8001, 0, "user", "b " * 100_000),
    ]
    frame = spark.createDataFrame(rows, TURNS).withColumn("pos", F.lit("x")).withColumn("k1", F.lit(1)).withColumn("node", F.lit(2))
    want = plain_trie(plain_rebuilt(rows))
    turns, members = rebuilt(frame)
    assert found(prefix_trie.build(turns, members, width=16, rows=64, apart=3, one_task=20)) == want
    assert found(prefix_trie.build(turns, members)) == want


def test_all_alike_and_nothing(spark):
    same = [(c, t, "user", f"{t}") for c in range(0, 2000) for t in range(2)]
    turns = prefix_trie.numbered_turns(spark.createDataFrame(same, TURNS))
    members = spark.range(2000).withColumnRenamed("id", "conv_id")
    assert found(prefix_trie.build(turns, members)) == plain_trie({c: [("user", "0"), ("user", "1")] for c in range(2000)})
    empty = prefix_trie.numbered_turns(spark.createDataFrame([], TURNS))
    assert prefix_trie.build(empty, members.limit(0)).collect() == []
    # conversations without turns end at the root
    assert {x[:6] for x in found(prefix_trie.build(empty, members.limit(3)))} == {(0, 0, None, 3, 0, 1)}


@pytest.mark.parametrize(("apart", "one_task"), [(32, 1 << 14), (4, 10), (2, 1)])
def test_ranking_lists(spark, apart, one_task):
    r = random.Random(apart)
    ids = [(r.randrange(2**62), r.randrange(9)) for _ in range(700)]
    rows, want = [], {}
    for part in (ids[:400], ids[400:401], ids[401:]):
        a = b = 0
        for k in range(len(part) - 1, -1, -1):
            x, y = r.randrange(5), r.randrange(9)
            nxt = part[k + 1] if k + 1 < len(part) else (None, None)
            rows.append((*part[k], *nxt, x, y))
            a, b = a + x, b + y
            want[part[k]] = (a, b)
    r.shuffle(rows)
    links = spark.createDataFrame(rows, "c long, s long, nc long, ns long, a long, b long")
    sums = list_ranking.suffix_sums(links, apart=apart, one_task=one_task).collect()
    assert {(x.c, x.s): (x.a, x.b) for x in sums} == want and len(sums) == len(want)
    assert list_ranking.suffix_sums(links.limit(0)).collect() == []


@pytest.mark.parametrize("piece", [3, 1 << 15])
def test_digests_of_groups(spark, piece):
    r = random.Random(6)
    rows = [("hot", i * 3) for i in range(500)] + [(f"g{r.randrange(60)}", i) for i in range(300)] + [("one", 2**60)]
    r.shuffle(rows)
    got = {x.node: x.digest for x in group_digests.digests(spark.createDataFrame(rows, "node string, number long").repartition(6), piece).collect()}
    groups = {}
    for node, number in rows:
        groups.setdefault(node, []).append(number)
    assert got == {n: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest() for n, v in groups.items()}


def test_hot_keys_meet_their_row_where_they_are(spark):
    rows = spark.createDataFrame([(0, i) for i in range(900)] + [(1 + i % 50, i) for i in range(300)] + [(None, 1)], "k long, v long")
    lookup = spark.createDataFrame([(k, k * 10) for k in range(40)], "k long, w long")
    for how in ("inner", "left"):
        want = sorted(map(tuple, rows.join(lookup, ["k"], how).collect()), key=str)
        assert sorted(map(tuple, spread_join(rows, lookup, ["k"], how).collect()), key=str) == want
    assert HOT_KEYS <= 20_000
