"""Repairing the structure of conversations with the cheapest edits, by iterative-deepening A*.

A conversation's rows, by turn, are to get roles of the form ``(s?(ua)+)?`` (initials of the roles). Each row is kept (K, free), gets
role user or assistant (R, 1) or is deleted (D, 2); an empty user or assistant row may be inserted anywhere (I, 5). Blank and
duplicate rows must go; a truncated row that stays costs 5 more. Among the cheapest repairs that with the ASCII-least string of
initials is taken.

``solve`` searches depth first in ASCII order of the edits under a growing bound on the cost. What is still to be paid is bounded from
below by what each remaining row costs at least; a table keeps, for each (row, state of the form), the largest budget that has failed.
The first path found under the first bound that has one is therefore the answer.

Nothing holds a conversation together: rows are sorted by range over all partitions, so one conversation may span many.
Conversations of up to ``SEGMENT`` rows inside a partition are solved at once. Of all others, segments are solved for each pair of
states at their ends, joined to pieces of at most ``PIECE`` rows (equal costs: the lesser string; no string of equal cost begins
another, since all edits after it cost something, so the choice carries over), and the pieces are followed in order by one stream that
keeps the few unsettled pieces. That stream also feeds the SHA-256 of the repaired text, which is sequential by its definition.

Defined results: null roles and texts count as one space; null conv_ids are one conversation (conv_ids are numbers); rows of one turn
go by role, then text; null turns come first; equal rows are counted before anything is sorted; a conversation without rows gives no
row; empty tables give none. Texts pass through Python once, whole. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.llm.common import stored, text_key

SEGMENT, PIECE = 32, 4096
SPACE = " \t\n\x0b\x0c\r"
DELETE, INSERT, REROLE, KEPT_TRUNCATED = 2, 5, 1, 5
#: States of the form: nothing yet, after s, after u, after ua (may end). The next state by initial.
STEPS = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
ENDS = frozenset((0, 3))
#: The role that may be put in at each state.
WANTED = ["user", "user", "assistant", "user"]
#: Any state can do what another does for at most this much more (drop the s row, put in u and a).
SLACK = DELETE + 2 * INSERT
IMPOSSIBLE = 1 << 60

Row = tuple[str, bool, bool]  # initial of the role, must go, truncated


def solve(rows: list[Row], start: int = 0, goals: frozenset[int] = ENDS) -> tuple[int, str] | None:
    """(cost, initials of the edits) of the best repair that leads from state ``start`` to one of ``goals``; None if none does."""
    n = len(rows)
    least, keepable = [0] * (n + 1), [False] * (n + 1)
    for i in range(n - 1, -1, -1):
        initial, gone, truncated = rows[i]
        least[i] = least[i + 1] + (DELETE if gone or truncated else 0 if initial in ("s", "u", "a") else REROLE)
        keepable[i] = keepable[i + 1] or initial == "s" and not gone

    def bound(i: int, state: int) -> int:
        if goals <= {0} and state or goals == {1} and not (state == 1 or state == 0 and keepable[i]):
            return IMPOSSIBLE
        return least[i]

    failed: dict[tuple[int, int], int] = {}

    def search(i: int, state: int, left: int) -> str | None:
        if i == n and state in goals:
            return ""
        if bound(i, state) > left or failed.get((i, state), -1) >= left:
            return None
        want = WANTED[state]
        if i < n:
            initial, gone, truncated = rows[i]
            stays = KEPT_TRUNCATED if truncated else 0
            if left >= DELETE and (rest := search(i + 1, state, left - DELETE)) is not None:
                return "D" + rest
        if left >= INSERT and (rest := search(i, STEPS[state][want[0]], left - INSERT)) is not None:
            return "I" + rest
        if i < n and not gone:
            after = STEPS[state].get(initial)
            if after is not None and left >= stays and (rest := search(i + 1, after, left - stays)) is not None:
                return "K" + rest
            if initial != want[0] and left >= stays + REROLE and (rest := search(i + 1, STEPS[state][want[0]], left - stays - REROLE)) is not None:
                return "R" + rest
        failed[i, state] = left
        return None

    limit = bound(0, start)
    while limit < IMPOSSIBLE:
        found = search(0, start, limit)
        if found is not None:
            return limit, found
        limit += 1
    return None


def apply(edits: str, roles: list[str], texts: list[str], state: int = 0) -> tuple[list[str], int]:
    """The repaired rows as ``role:text`` and the state after them."""
    out, i = [], 0
    for edit in edits:
        if edit == "I":
            role, text = WANTED[state], ""
        else:
            role, text = roles[i], texts[i]
            i += 1
            if edit == "D":
                continue
            role = WANTED[state] if edit == "R" else role
        state = STEPS[state][role[0]]
        out.append(f"{role}:{text}")
    return out, state


Options = dict[tuple[int, int], tuple[int, str]]


def options(rows: list[Row]) -> Options:
    """The best repair of a piece for each pair of states at its ends, segment by segment."""
    total: Options = {(s, s): (0, "") for s in range(4)}
    for k in range(0, len(rows), SEGMENT):
        part = rows[k : k + SEGMENT]
        found = {(a, b): best for a in {b for _, b in total} for b in range(4) if (best := solve(part, a, frozenset((b,))))}
        joined: Options = {}
        for (a, b), (cost, edits) in total.items():
            for c in range(4):
                if (b, c) in found:
                    new = (cost + found[b, c][0], edits + found[b, c][1])
                    if (a, c) not in joined or new < joined[a, c]:
                        joined[a, c] = new
        total = joined
    return total


def _illegal(roles: list[str]) -> int:
    return sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))


FOUND = "cid string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired string, repaired_sha256 string"
PIECES = f"{FOUND}, whole boolean, part long, seq long, roles array<string>, texts array<string>, ways array<struct<a:int,b:int,cost:long,edits:string>>"
NAMES, PIECE_NAMES = ([f.split()[0] for f in x.split(", ")] for x in (FOUND, PIECES))


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _runs(batches: Iterable[pd.DataFrame], most: int) -> Iterator[tuple[str, bool, list[tuple]]]:
    """(cid, last, rows) for pieces of at most ``most`` rows of each conversation, in order; rows are (role, text, fault), copies apart."""
    cid, rows = None, []
    for batch in batches:
        for key, role, text, n, fault in zip(*(batch[c] for c in ("cid", "role", "text", "n", "fault"))):
            if key != cid and rows:
                yield cid, True, rows
                rows = []
            cid = key
            for copy in range(n):
                if len(rows) == most:
                    yield cid, False, rows
                    rows = []
                rows.append((role, text, "duplicate" if copy and fault != "blank" else fault))
    if rows:
        yield cid, True, rows


def _cut(keep_text: bool, most: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        out: list[tuple] = []
        weight, waiting, first, seq = 0, None, True, 0
        for cid, last, rows in _runs(batches, most):
            if waiting is not None:
                out.append(_solved(part, *waiting, keep_text))
            # What is first or last in its partition may go on in the next one.
            small = last and seq == 0 and not first and len(rows) <= SEGMENT
            waiting = (cid, seq, rows, small)
            seq = 0 if last else seq + 1
            first = first and not last
            weight += sum(len(r[1]) for r in rows)
            if len(out) >= 1000 or weight > 1 << 23:
                yield pd.DataFrame(out, columns=PIECE_NAMES)
                out, weight = [], 0
        if waiting is not None:
            out.append(_solved(part, *waiting[:3], False, keep_text))
        yield pd.DataFrame(out, columns=PIECE_NAMES)

    return run


def _solved(part: int, cid: str, seq: int, rows: list[tuple], whole: bool, keep_text: bool) -> tuple:
    roles, texts, faults = (list(x) for x in zip(*rows))
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    marked = [(role[:1], fault in ("blank", "duplicate"), fault == "truncated") for role, _, fault in rows]
    if not whole:
        ways = [(a, b, cost, edits) for (a, b), (cost, edits) in options(marked).items()]
        return cid, *counts, _illegal(roles), None, None, None, None, False, part, seq, roles, texts, ways
    cost, edits = solve(marked)
    repaired = "\n".join(apply(edits, roles, texts)[0])
    return cid, *counts, _illegal(roles), cost, edits, repaired if keep_text else None, _digest(repaired), True, part, seq, None, None, None


class _Followed:
    """One conversation, piece by piece: the best way to each state, as the choices not yet common to all of them."""

    def __init__(self, cid: str, keep_text: bool):
        self.cid, self.counts, self.last_role = cid, [0, 0, 0, 0], None
        self.ways: dict[int, tuple[int, list[str]]] = {0: (0, [])}
        self.pieces: list[tuple[list[str], list[str]]] = []
        self.state, self.digest, self.begun = 0, hashlib.sha256(), False
        self.edits: list[str] = []
        self.kept: list[str] | None = [] if keep_text else None

    def add(self, piece: dict) -> None:
        for k, name in enumerate(("blank", "duplicate", "truncated", "illegal")):
            self.counts[k] += int(piece[name])
        roles = list(piece["roles"])
        self.counts[3] += _illegal([self.last_role, roles[0]]) if self.last_role is not None else 0
        self.last_role = roles[-1]
        self.pieces.append((roles, list(piece["texts"])))
        new: dict[int, tuple[int, list[str]]] = {}
        for way in piece["ways"]:
            a, b, cost, edits = (way[k] for k in ("a", "b", "cost", "edits"))
            if a in self.ways:
                been, path = self.ways[a]
                found = (been + cost, [*path, edits])
                if b not in new or (found[0], "".join(found[1])) < (new[b][0], "".join(new[b][1])):
                    new[b] = found
        best = min(cost for cost, _ in new.values())
        self.ways = {b: way for b, way in new.items() if way[0] <= best + SLACK}
        while self.pieces and len({path[0] for _, path in self.ways.values()}) == 1:
            self._settle(next(iter(self.ways.values()))[1][0])
            for _, path in self.ways.values():
                del path[0]

    def _settle(self, edits: str) -> None:
        roles, texts = self.pieces.pop(0)
        rows, self.state = apply(edits, roles, texts, self.state)
        for row in rows:
            text = f"\n{row}" if self.begun else row
            self.begun = True
            self.digest.update(text.encode())
            if self.kept is not None:
                self.kept.append(text)
        self.edits.append(edits)

    def end(self) -> tuple:
        # What is missing at the end is put in; only then may ways be compared.
        final = []
        for state, (cost, path) in self.ways.items():
            more, edits = solve([], state)
            final.append((cost + more, "".join(path) + edits, path, edits))
        cost, _, path, edits = min(final)
        for piece in list(path):
            self._settle(piece)
        self.pieces.append(([], []))
        self._settle(edits)
        return self.cid, *self.counts, cost, "".join(self.edits), None if self.kept is None else "".join(self.kept), self.digest.hexdigest()


def _follow(keep_text: bool) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: _Followed | None = None
        out: list[tuple] = []
        for batch in batches:
            for piece in batch.to_dict("records"):
                if now is None or piece["cid"] != now.cid:
                    if now is not None:
                        out.append(now.end())
                    now = _Followed(piece["cid"], keep_text)
                now.add(piece)
            if out:
                yield pd.DataFrame(out, columns=NAMES)
                out = []
        if now is not None:
            yield pd.DataFrame([now.end()], columns=NAMES)

    return run


def as_text(conv_id: Column) -> Column:
    """A conversation's number as text, one space for null."""
    return F.coalesce(conv_id.cast("string"), F.lit(" "))


def faults(turns: DataFrame) -> DataFrame:
    """(cid, turn, role, text, n, fault) of the distinct rows; ``n`` equal rows, of which only the first may be no duplicate."""
    space = F.lit(" ")
    plain = turns.select(as_text(turns["conv_id"]).alias("cid"), turns["turn"], F.coalesce(turns["role"], space).alias("role"), F.coalesce(turns["text"], space).alias("text"))
    rows = plain.groupBy("cid", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    k1, k2 = text_key(F.col("text"))
    # A turn in an order of its own, null least, with which the first of equal texts is found before rows meet.
    rows = rows.withColumns({"k1": k1, "k2": k2, "at": F.struct(F.col("turn").isNotNull().alias("some"), F.coalesce("turn", F.lit(0)).alias("turn"))})
    firsts = rows.groupBy("cid", "role", "k1", "k2").agg(F.min("at").alias("at")).withColumn("first", F.lit(True))
    core = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = (
        F.when(core == "", "blank")
        .when(F.col("first").isNull(), "duplicate")
        .when(~F.right(core, F.lit(1)).isin(".", "!", "?"), "truncated")
        .otherwise("")
    )
    return rows.join(firsts, ["cid", "role", "k1", "k2", "at"], "left").select("cid", "turn", "role", "text", "n", fault.alias("fault"))


def repair(turns: DataFrame, with_text: bool = False, piece_rows: int = PIECE) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of each conversation of ``turns`` (conv_id,
    turn, role, text); ``with_text`` adds ``repaired``, its repaired rows as lines ``role:text``."""
    kind = turns.schema["conv_id"].dataType
    order = ["cid", "turn", "role", "text"]
    rows = faults(turns).repartitionByRange(*order).sortWithinPartitions(*order).select("cid", "role", "text", "n", "fault")
    pieces = stored(rows.mapInPandas(_cut(with_text, piece_rows), PIECES), "repair")
    follow = pieces.filter(~F.col("whole")).select("cid", "blank", "duplicate", "truncated", "illegal", "part", "seq", "roles", "texts", "ways")
    followed = follow.repartition("cid").sortWithinPartitions("cid", "part", "seq").mapInPandas(_follow(with_text), FOUND)
    found = pieces.filter("whole").select(*NAMES).unionByName(followed)
    spans = turns.groupBy(as_text(turns["conv_id"]).alias("cid")).agg(F.max("turn").alias("last"), F.min("turn").alias("first"), F.count_distinct("turn").alias("n"))
    gaps = F.coalesce(F.col("last") - F.col("first") + 1 - F.col("n"), F.lit(0)).cast("long")
    joined = found.join(spans.select("cid", gaps.alias("gaps")), "cid")
    conv_id = F.when(F.col("cid") != " ", F.col("cid").cast(kind)).alias("conv_id")
    text = ["repaired"] if with_text else []
    return joined.select(conv_id, "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256", *text)
