"""Repair of conversations against exhaustive search and a plain version of the whole query."""

import hashlib
import heapq
import itertools
import random
import zlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelspark.llm import repair
from reelspark.llm.queries import QUERIES

TURNS = T.StructType([T.StructField(c, t) for c, t in (("conv_id", T.LongType()), ("turn", T.LongType()), ("role", T.StringType()), ("text", T.StringType()))])


def outcome(edits, rows):
    """Cost of a string of edits, None if it does not fit the rows or the form."""
    cost, i, roles = 0, 0, ""
    for e in edits:
        want = "a" if roles[-1:] == "u" else "u"
        if e == "I":
            cost, roles = cost + 5, roles + want
            continue
        if i == len(rows):
            return None
        initial, gone, truncated = rows[i]
        i += 1
        if e == "D":
            cost += 2
            continue
        if gone:
            return None
        cost += (5 if truncated else 0) + (e == "R")
        roles += initial if e == "K" else want
        if e == "K" and initial not in ("s", "u", "a"):
            return None
    body = roles[1:] if roles[:1] == "s" else roles
    fits = body == "ua" * (len(body) // 2) and (body or not roles)
    return cost if i == len(rows) and fits else None


def exhaustive(rows):
    best = None
    for n in range(len(rows) + 3):
        for edits in itertools.product("DIKR", repeat=n):
            cost = outcome(edits, rows)
            if cost is not None and (best is None or (cost, "".join(edits)) < best):
                best = (cost, "".join(edits))
    return best


def cheapest_first(rows, start=0, goals=(0, 3)):
    """Uniform-cost search in order of (cost, edits)."""
    heap, seen = [(0, "", 0, start)], set()
    while heap:
        cost, edits, i, state = heapq.heappop(heap)
        if i == len(rows) and state in goals:
            return cost, edits
        if (i, state) in seen:
            continue
        seen.add((i, state))
        want = "a" if state == 2 else "u"
        to = {"u": 2, "a": 3}[want]
        heapq.heappush(heap, (cost + 5, edits + "I", i, to))
        if i < len(rows):
            initial, gone, truncated = rows[i]
            heapq.heappush(heap, (cost + 2, edits + "D", i + 1, state))
            if not gone:
                kept = cost + (5 if truncated else 0)
                heapq.heappush(heap, (kept + 1, edits + "R", i + 1, to))
                if initial == want or initial == "s" and state == 0:
                    heapq.heappush(heap, (kept, edits + "K", i + 1, 1 if initial == "s" else to))
    return None


def some_rows(r, n):
    return [(r.choice("suauaua x"), r.random() < 0.15, r.random() < 0.2) for _ in range(n)]


def test_search_against_all_strings():
    r = random.Random(1)
    for _ in range(60):
        rows = some_rows(r, r.randrange(5))
        assert repair.solve(rows) == exhaustive(rows), rows


def test_search_between_states():
    r = random.Random(2)
    for _ in range(300):
        rows, start, goal = some_rows(r, r.randrange(12)), r.randrange(4), r.randrange(4)
        assert repair.solve(rows, start, frozenset((goal,))) == cheapest_first(rows, start, (goal,)), (rows, start, goal)


def test_segments_join_to_the_whole(monkeypatch):
    monkeypatch.setattr(repair, "SEGMENT", 3)
    r = random.Random(3)
    for _ in range(100):
        rows = some_rows(r, r.randrange(1, 20))
        ways = repair.options(rows)
        assert min(w for (a, b), w in ways.items() if a == 0 and b in (0, 3)) == min(repair.solve(rows, 0, frozenset((g,))) or (999, "") for g in (0, 3))


def plain_repair(rows):
    """The answer of the contract for one conversation's rows (turn, role, text)."""
    rows = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
    seen, marks = set(), []
    for _, role, text in rows:
        core = text.rstrip(" \t\n\x0b\x0c\r")
        marks.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    cost, audit = cheapest_first([(role[:1], m in ("blank", "duplicate"), m == "truncated") for (_, role, _), m in zip(rows, marks)])
    out, i = [], 0
    for e in audit:
        want = "assistant" if out and out[-1][0] == "u" else "user"
        if e == "I":
            out.append(f"{want}:")
            continue
        _, role, text = rows[i]
        i += 1
        if e != "D":
            out.append(f"{want if e == 'R' else role}:{text}")
    known = {t for t, _, _ in rows if t is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    text = "\n".join(out)
    return (gaps, *(marks.count(m) for m in ("blank", "duplicate", "truncated")), illegal, cost, audit, text, hashlib.sha256(text.encode()).hexdigest())


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired", "repaired_sha256")


def by_conversation(rows):
    groups = {}
    for conv, *rest in rows:
        groups.setdefault(conv, []).append(rest)
    return groups


def check(spark, rows, piece_rows=repair.PIECE):
    frame = spark.createDataFrame([(c, t, r, x) for c, t, r, x in rows], TURNS).withColumn("cid", F.lit("x")).withColumn("fault", F.lit(1))
    space = lambda v: " " if v is None else v
    want = {c: plain_repair([(t, space(r), space(x)) for t, r, x in g]) for c, g in by_conversation(rows).items()}
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in repair.repair(frame, with_text=True, piece_rows=piece_rows).collect()}
    assert got == want
    return got


def test_edges(spark):
    rows = [
        (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."),
        (2, 0, "user", "cut"),
        (3, 0, None, None), (3, None, "user", "A."), (3, 1, "tool", "B."),
        (None, 0, "user", "Q?"), (None, 0, "user", "Q?"), (None, None, "assistant", "x"),
        (4, 2**40, "", ""), (4, 5, "", "a."),
        (2**60 + 1, 0, "system", "S."), (2**60 + 3, 0, "assistant", "S."), (2**60 + 3, 0, "assistant", "S."), (2**60 + 3, 3, "user", "long. " * 50_000),
    ]
    got = check(spark, rows)
    assert got[1][6] == "KK" and got[2**60 + 1][6] == "D"
    assert repair.repair(spark.createDataFrame([], TURNS)).collect() == []


def test_long_conversations_span_partitions(spark):
    """One conversation holds most rows: it is cut into pieces and segments that are joined again."""
    r = random.Random(7)
    rows = [(1, t, r.choice(["user", "assistant"]), r.choice(["a.", "b!", "c", "", f"{t}.", f"{t} x?"])) for t in range(1500)]
    rows += [(c, t, ("user", "assistant")[t % 2], f"{c}-{t}.") for c in range(2, 40) for t in range(r.randrange(1, 7))]
    check(spark, rows, 50)
    check(spark, rows)


def test_pieces_are_followed_like_the_whole(monkeypatch):
    r = random.Random(8)
    monkeypatch.setattr(repair, "SEGMENT", 4)
    for _ in range(30):
        rows = [(t, r.choice(["user", "assistant", "system", "x"]), r.choice(["a.", "b", "", f"{t}.", f"{t}?"])) for t in range(r.randrange(1, 60))]
        want = plain_repair(rows)
        seen, faulty = set(), []
        for _, role, text in rows:
            core = text.rstrip()
            faulty.append((role, text, "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else ""))
            seen.add((role, text))
        now = repair._Followed("1", True)
        for k in range(0, len(faulty), 7):
            piece = dict(zip(repair.PIECE_NAMES, repair._solved(0, "1", k, faulty[k : k + 7], False, True)))
            now.add(piece | {"ways": [dict(zip(("a", "b", "cost", "edits"), w)) for w in piece["ways"]]})
        assert now.end() == ("1", *want[1:])


def damaged_plainly(rows):
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k:
            text = "" if k == 1 else text.translate(str.maketrans("", "", ".!?")) if k == 2 else text
            yield from [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_plain_version(spark, sf):
    path = f"/root/testdata/{sf}"
    table = pq.read_table(f"{path}/conversations.parquet").select(["conv_id", "turn", "role", "text"]).to_pylist()
    groups = by_conversation(damaged_plainly([tuple(x.values()) for x in table]))
    got = {r.conv_id: tuple(r[c] for c in COLUMNS if c != "repaired") for r in QUERIES["op12_conversation_repair"](spark, path).collect()}
    assert len(got) == len({x["conv_id"] for x in table})
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    for conv, found in got.items():
        want = plain_repair(groups[conv]) if conv in groups else None
        assert found == (empty if want is None else want[:7] + want[8:]), conv
