"""SimHash near-duplicates with pigeonring filtering.

A fingerprint's 64 bits are a ring of four 16-bit segments. If two fingerprints differ in at most 3 bits, some segment
starts a chain whose first l segments together differ in at most 3 * l / 4 bits for every l: not at all in the first,
once in the first two, twice in the first three. The first two conditions are an equality: a fingerprint is filed
under (segment, its bits, the next segment's bits), and looks under its own key and under each key in which one zero bit
of the next segment is set (the other fingerprint of a pair looks for the reverse). Only what meets there goes through the
third condition and the full Hamming check.

Distinct fingerprints are linked, not documents, so copies cost nothing. A key that many fingerprints share is cut into
blocks; pairs of blocks are compared apart, and each reports a spanning forest of its links, never all pairs.

Defined results: null and wordless texts have fingerprint 0 and are linked like any other; null doc_ids take part and get
the least non-null doc_id of their component (null if there is none); repeated rows are linked; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelspark.llm.common import small, stored, text_key
from reelspark.llm.components import components

SEGMENTS, WIDTH, BITS = 4, 16, 3
#: Fingerprints of one key that are compared in one piece; larger keys are cut into blocks of about this many.
BLOCK = 2048
SEED = 42
#: Words of a text that are hashed at a time, so that a very long text needs bounded memory.
PIECE = 1 << 18
_BIT = (np.arange(256)[:, None] >> np.arange(8)) & 1


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set."""
    octets = hashes.view(np.uint8).reshape(-1, 8)
    if len(hashes) < 128:
        return np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.stack([np.bincount(octets[:, k], minlength=256) @ _BIT for k in range(8)]).ravel()


def fingerprint(text: str | None) -> int:
    """Signed 64-bit SimHash of the three-word shingles, repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < 3:
        shingles = 1
        counts = _bit_counts(np.array([digest(b" ".join(words), SEED)], "<u8"))
    else:
        shingles, counts = len(words) - 2, np.zeros(64, np.int64)
        for at in range(0, shingles, PIECE):
            part = words[at : at + PIECE + 2]
            counts += _bit_counts(
                np.array([digest(b"%b %b %b" % three, SEED) for three in zip(part, part[1:], part[2:])], "<u8")
            )
    return int(np.packbits(2 * counts > shingles, bitorder="little").view("<i8")[0])


@F.pandas_udf(T.LongType())
def fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([fingerprint(t) for t in texts], dtype="int64")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _segment(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, WIDTH * i).bitwiseAND(F.lit(0xFFFF))


def _looked_up(key: Column, after: Column) -> Column:
    """The keys with one zero bit of the last segment set."""
    masks = F.array(*[F.struct(F.lit(1 << b).cast("long").alias("mask")) for b in range(WIDTH)])
    zeros = F.filter(masks, lambda m: after.bitwiseAND(m["mask"]) == 0)
    return F.transform(zeros, lambda m: F.struct(key.bitwiseOR(m["mask"]).alias("key"), F.lit(False).alias("filed")))


def _filed(distinct: DataFrame) -> DataFrame:
    """(key, fp, filed): where each fingerprint is filed (true) and where it looks besides (false)."""
    rows = []
    for i in range(SEGMENTS):
        own, after = _segment(F.col("fp"), i), _segment(F.col("fp"), (i + 1) % SEGMENTS)
        key = F.shiftleft(F.lit(i).cast("long"), 2 * WIDTH).bitwiseOR(F.shiftleft(own, WIDTH)).bitwiseOR(after)
        rows += [F.array(F.struct(key.alias("key"), F.lit(True).alias("filed"))), _looked_up(key, after)]
    return distinct.select("fp", F.inline(F.concat(*rows)))


def _forest(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links (a, b) between positions of ``ids`` that join what was apart."""
    up = list(range(len(ids)))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist()):
        x, y = root(x), root(y)
        if x != y:
            up[max(x, y)] = min(x, y)
            kept.append((int(ids[x]), int(ids[y])))
    return kept


def _group_links(segment: int, filed: np.ndarray, looking: np.ndarray) -> list[tuple[int, int]]:
    """Links within one group: filed fingerprints against all of it."""
    ids = np.unique(np.concatenate([filed, looking]))
    turn = [WIDTH * ((segment + j) % SEGMENTS) for j in range(3)]
    first, second = [], []
    unsigned = ids.view(np.uint64)
    for x in np.searchsorted(ids, np.unique(filed)):
        apart = unsigned ^ unsigned[x]
        chain = sum(np.bitwise_count((apart >> np.uint64(t)) & np.uint64(0xFFFF)).astype(int) for t in turn)
        near = np.flatnonzero(chain * SEGMENTS <= 3 * BITS)
        near = near[np.bitwise_count(apart[near]) <= BITS]
        near = near[near != x]
        first.append(np.full(len(near), x))
        second.append(near)
    return _forest(ids, np.concatenate(first), np.concatenate(second)) if first else []


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints of ``distinct`` (fp) lying within 3 bits, as forests."""
    filed = _filed(distinct)
    busy = filed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("filed").alias("any"))
    busy = small(stored(busy.filter("any and n > 1").select("key", "n"), "keys"))
    rows = filed.join(busy, "key").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    looks = rows.select("key", "fp", F.lit(False).alias("filed"), F.explode(every).alias("i"), block.alias("j"))
    files = rows.filter("filed").select("key", "fp", "filed", block.alias("i"), F.explode(every).alias("j"))
    grouped = looks.unionByName(files).withColumn("g", F.xxhash64("key", "i", "j"))

    def forests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def flush(frame: pd.DataFrame) -> pd.DataFrame:
            out: list[tuple[int, int]] = []
            at = frame[["g", "key", "i", "j"]].to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1, [len(at)]])
            fps, is_filed, keys = frame["fp"].to_numpy(), frame["filed"].to_numpy(), frame["key"].to_numpy()
            for s, e in zip(cuts[:-1], cuts[1:]):
                mine, all_ = fps[s:e][is_filed[s:e]], fps[s:e]
                if e - s > 1 and len(mine):
                    out += _group_links(int(keys[s]) >> (2 * WIDTH), mine, all_)
            return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

        for batch in batches:
            if held and not len(batch):
                continue
            frame = pd.concat([*held, batch]) if held else batch
            last = frame[["g", "key", "i", "j"]].iloc[-1] if len(frame) else None
            if last is None:
                continue
            tail = (frame["g"] == last["g"]) & (frame["key"] == last["key"]) & (frame["i"] == last["i"]) & (frame["j"] == last["j"])
            held = [frame[tail]]
            yield flush(frame[~tail])
        if held:
            yield flush(held[0])

    dealt = grouped.repartition("g").sortWithinPartitions("g", "key", "i", "j")
    return dealt.mapInPandas(forests, "a long, b long").distinct()


def classes(printed: DataFrame) -> DataFrame:
    """(fp, component_id) of every distinct fingerprint of ``printed`` (doc_id, fp)."""
    least = stored(printed.groupBy("fp").agg(F.min("doc_id").alias("own")), "prints")
    linked = components(links(least.select("fp")))
    named = linked.join(least, linked["node"] == least["fp"]).select("root", "node", "own")
    top = named.groupBy("root").agg(F.min("own").alias("component_id"))
    moved = named.join(top, "root").select(F.col("node").alias("fp"), "component_id")
    return least.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "own").alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id), a row for each row of ``docs`` (doc_id, text)."""
    printed = stored(docs.select("doc_id", fingerprints(docs["text"]).alias("fp")), "printed")
    return printed.join(classes(printed), "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each component of near-duplicates, all columns as they were: the one with the least doc_id.

    Null doc_ids come last; of rows with one doc_id the one with the least text key stays, of rows that agree in both any.
    """
    key = text_key(docs["text"])
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        F.struct(docs["doc_id"].isNull().alias("n"), docs["doc_id"].alias("d"), key[0].alias("x"), key[1].alias("y")).alias("o"),
        fingerprints(docs["text"]).alias("fp"),
    )
    printed = stored(rows.select("fp", F.col("o.d").alias("doc_id"), "o"), "printed")
    first = printed.groupBy("fp").agg(F.min("o").alias("o"))
    linked = components(links(printed.select("fp").distinct()))
    roots = first.join(linked, first["fp"] == linked["node"], "left").select(F.coalesce("root", "fp").alias("root"), "o")
    kept = roots.groupBy("root").agg(F.min("o").alias("o")).select(*[F.col(f"o.{c}").alias(c) for c in "ndxy"])
    # A text has one fingerprint, so the order key alone names the row that stays.
    at = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].alias("d"), key[0].alias("x"), key[1].alias("y"))
    chosen = at.alias("l").join(kept.alias("r"), F.col("l.d").eqNullSafe(F.col("r.d")) & (F.col("l.x") == F.col("r.x")) & (F.col("l.y") == F.col("r.y")), "left_semi")
    return chosen.groupBy("d", "x", "y").agg(F.first("row").alias("row")).select("row.*")
