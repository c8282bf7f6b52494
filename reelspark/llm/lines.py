"""Line deduplication by a deletion-neighbourhood join.

Lines are compared as sequences of words. Two lines lie within one edit (a word put in, left out or replaced) exactly if
leaving out at most one word of each gives the same sequence. So a line is filed under the hash of each sequence that
lacks one of its words, and under its own; what meets there is verified word by word, and the earliest stays. Replacements
also share the place of the missing word, so the least line of a (sequence, place) group stands for the whole group and
no pairs within a group are formed.

Before variants are emitted, lines without any possible partner are set aside without loss: one edit leaves either the
first or the last half of the words untouched, so a line whose halves no other line shares has no neighbour.

From twice ``per_words`` words on, the bound grows: a line of n words may be k = n // ``per_words`` edits from a shorter or
equal one. k edits leave one of any k + 1 disjoint runs of its words untouched, so k + 1 runs of the longer line are looked up
among all runs of the others, at most k places apart; runs that a sample finds in many lines are avoided where the rest
suffices. Hashes of runs are dealt once for each line in packed form, sorted, and met in sorted arrays, so only runs that two
lines share become rows. What meets is compared with the earliest line of its run first, so a large group of near copies is settled
in proportion to its size; lines not settled by that meet all earlier ones. Lengths and sketches of words go ahead of the words.

Order is (doc_id, text, line number), a null doc_id first. Lines under ``min_words`` words are left alone, lines under
``near_words`` words only lose exact repetitions. A line goes if an earlier one lies within the bound, whether or not that
one stays. Defined results: null texts stay null; rows that agree in doc_id and text count as one document and change
alike; a document left without words by the removal goes; ``n_chars``, if there, follows the text; other columns pass
through; empty tables give no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelspark.llm import common
from reelspark.llm.common import BROADCAST_ROWS, small, text_key

MIN_WORDS, NEAR_WORDS = 2, 5
#: Least words of a line in the query: exact repetition covers every line with a word.
ANY_WORDS = 1
#: Words for each edit that a line may differ by (one edit from ``near_words`` words on); None stands for one edit at any length.
PER_WORDS = 5
#: Runs of words to one packed bucket, sampled lines, and the share of these from which on a run is avoided.
BUCKET_RUNS, SAMPLE_LINES, HOT_SHARE = 1_000_000, 20_000, 1 / 500
#: Bytes of text whose words are hashed at a time, and runs of words dealt at a time.
CHUNK, DEALT_RUNS = 1 << 18, 1 << 21
#: Bits of a run's key inside its bucket, of buckets, of a line's number among those dealt together, and of ``h1`` left out of a dealt line's name.
KEY_BITS, BUCKET_BITS, LINE_BITS, ID_SHIFT = 28, 15, 20, 24
#: Line numbers that weigh as much as a row of a table that may travel.
NUMBERS_A_ROW = 8
#: White space of the words, as in the regular expression of ``_words``.
_SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\x0b\f\r", np.uint8))
#: Fixed moduli and base of the sequence hash (two primes under 2 ** 31).
PRIMES, BASE = (2147483647, 2147483629), 1_000_003


def stored(df: DataFrame, label: str) -> DataFrame:
    """``common.stored``; the shuffle files behind the table go as soon as it is written."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, "false")
    conf.set(name, "true")
    try:
        return common.stored(df, label)
    finally:
        conf.set(name, before)


def _powers(n: int, prime: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    done, step = 1, BASE % prime
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(step) % np.uint64(prime)
        done += more
        step = step * step % prime
    return out


def neighbourhood(words: list[str]) -> np.ndarray:
    """Hash of the sequence without word i for each i, then of the whole sequence; linear in the number of words."""
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
    n, out = len(hashes), np.zeros(len(hashes) + 1, np.uint64)
    for prime in PRIMES:
        p = np.uint64(prime)
        terms = hashes % p * _powers(n, prime) % p
        before = np.concatenate([[np.uint64(0)], np.cumsum(terms, dtype=np.uint64)]) % p
        after = (before[n] + p - before[1:]) % p
        one_down = np.uint64(pow(BASE, -1, prime))
        lacking = (before[:-1] + after * one_down % p) % p
        out = (out << np.uint64(31)) | np.append(lacking, before[n])
    return out.view(np.int64)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _neighbourhoods(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for lines in batches:
        yield pd.Series([neighbourhood(list(words)) for words in lines], dtype=object)


@F.pandas_udf(T.StringType())
def _without(texts: pd.Series, gone: pd.Series) -> pd.Series:
    """The texts less the lines of the given numbers; null stays null."""

    def rest(text: str, numbers) -> str:
        out = set(numbers.tolist())
        return "\n".join(line for i, line in enumerate(text.split("\n")) if i not in out)

    return pd.Series([None if t is None else rest(t, g) for t, g in zip(texts, gone)], dtype=object)


def _words(line: Column) -> Column:
    return F.array_remove(F.split(line, r"\s+"), "")


@functools.cache
def _odd_powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2 ** 64."""
    out = []
    for base in (0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)):
        powers = np.full(1 << bits, base, np.uint64)
        powers[0] = 1
        out.append(np.multiply.accumulate(powers))
    return out[0], out[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xBF58476D1CE4E5B9), (32, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _sums(values: np.ndarray) -> np.ndarray:
    """Running sums from which ``_hash`` takes the hash of any stretch of ``values``."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _odd_powers(max(16, len(values).bit_length()))[0][: len(values)], out=out[1:])
    return out


def _hash(sums: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (sums[end] - sums[first]) * _odd_powers(max(16, (len(sums) - 1).bit_length()))[1][first]


def _line_ends(at: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, line number, first byte, end) of every line of the texts that lie in ``data`` between the places ``at``."""
    breaks = np.flatnonzero(data[at[0] : at[-1]] == 10) + at[0]
    many = np.searchsorted(breaks, at[1:]) - np.searchsorted(breaks, at[:-1]) + 1
    begin = np.cumsum(many) - many
    text = np.repeat(np.arange(len(many)), many)
    first, end = np.empty(len(text), np.int64), np.empty(len(text), np.int64)
    inner = np.ones(len(text), bool)
    inner[begin] = False
    first[begin], first[inner] = at[:-1], breaks + 1
    inner[:] = True
    inner[begin + many - 1] = False
    end[begin + many - 1], end[inner] = at[1:], breaks
    return text, np.arange(len(text)) - begin[text], first, end


def _hashed(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of adjoining lines, how many each line has, and whether just single spaces part them."""
    a = first[0]
    part = data[a : end[-1]]
    space = _SPACE[part]
    edge = np.zeros(len(part) + 1, bool)
    edge[first - a] = True
    opens, closes = ~space, ~space
    opens[1:] &= space[:-1] | edge[1:-1]
    closes[:-1] &= space[1:] | edge[1:-1]
    opens, closes = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    n = np.bincount(np.searchsorted(first - a, opens, "right") - 1, minlength=len(first))
    spaces = np.append(0, np.cumsum(space))
    other = np.append(0, np.cumsum(space & (part != 32)))
    plain = (spaces[end - a] - spaces[first - a] == n - 1) & (other[end - a] == other[first - a])
    return _mixed(_hash(_sums(part.astype(np.uint64) + np.uint64(1)), opens, closes)), n, plain


def _identities(data: np.ndarray, first: np.ndarray, end: np.ndarray, plain: np.ndarray) -> np.ndarray:
    """128 bits in two longs for the word sequence of each line."""
    view, out = memoryview(data), []
    for a, b, as_is in zip(first.tolist(), end.tolist(), plain.tolist()):
        out.append(xxhash.xxh3_128_digest(view[a:b] if as_is else b" ".join(view[a:b].tobytes().split())))
    return np.frombuffer(b"".join(out), "<i8").reshape(-1, 2)


def _chunks(texts: pa.Array, min_words: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, line number, identity, words in the line) of lines with at least ``min_words`` words and the words' hashes, by chunks."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, places, data = texts.buffers()
    at = np.frombuffer(places, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data or b"", np.uint8)
    text, number, first, end = _line_ends(at, data)
    for rows in np.split(np.arange(len(text)), np.flatnonzero(np.diff(first // CHUNK)) + 1):
        hashes, n, plain = _hashed(data, first[rows], end[rows])
        kept = n >= min_words
        rows = rows[kept]
        if len(rows):
            yield text[rows], number[rows], _identities(data, first[rows], end[rows], plain[kept]), n[kept], hashes[np.repeat(kept, n)]


def half_keys(hashes: np.ndarray, n: np.ndarray, near_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the first and last words that an edit towards a line as long, or one word longer, can leave untouched; keys of each line."""
    sums, start, near = _sums(hashes), np.cumsum(n) - n, n >= near_words
    start, long, keys = start[near], n[near], []
    for longer in (0, 1):
        m = (long + longer - 1) // 2
        for side, first in ((0, start), (1, start + long - m)):
            keys.append(_mixed(_hash(sums, first, first + m) + ((long + longer) * 2 + side).astype(np.uint64) * np.uint64(0xD1342543DE82EF95)))
    return np.stack(keys, 1).reshape(-1).view(np.int64), np.where(near, 4, 0)


def _sketches(hashes: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Two longs of 32 counters of a line's words, 15 at most, and two of 128 bits, one turned by each word: an edit adds one to a counter at most and turns two bits."""
    line = np.repeat(np.arange(len(n)), n)
    counts = np.minimum(np.bincount(line * 32 + (hashes & np.uint64(31)).astype(np.int64), minlength=32 * len(n)), 15).astype(np.uint64)
    packed = np.bitwise_or.reduce(counts.reshape(-1, 2, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4)), 2)
    turns = np.bincount(line * 128 + (hashes >> np.uint64(32) & np.uint64(127)).astype(np.int64), minlength=128 * len(n)) & 1
    bits = np.packbits(turns.astype(np.uint8).reshape(-1, 128), 1).view(np.uint64)
    return [np.ascontiguousarray(c).view(np.int64) for c in (packed[:, 0], packed[:, 1], bits[:, 0], bits[:, 1])]


#: Packed counters and turned bits of a line's words.
COUNTERS, TURNED = ("c0", "c1"), ("t0", "t1")
SKETCH = COUNTERS + TURNED


def beyond(mine: list[Column], other: list[Column]) -> Column:
    """By how many words the counters of one line exceed those of another."""
    total = None
    for x, y in zip(mine, other):
        for shift in (0, 4):
            low, high = (F.shiftrightunsigned(c, shift).bitwiseAND(F.lit(0x0F0F0F0F0F0F0F0F)) for c in (x, y))
            # Each byte holds 16 more than the difference, so that nothing is borrowed.
            apart = low + F.lit(0x1010101010101010) - high
            more = apart.bitwiseAND(F.shiftright(apart, 4).bitwiseAND(F.lit(0x0101010101010101)) * 15)
            total = more if total is None else total + more
    wide = F.lit(0x00FF00FF00FF00FF)
    return (total.bitwiseAND(wide) + F.shiftright(total, 8).bitwiseAND(wide)) % 65535


def _shapes(docs: DataFrame, min_words: int, near_words: int, sketched: bool = False) -> DataFrame:
    """(h1, h2, place, n, halves), and the sketch if asked for, of every line with at least ``min_words`` words."""

    def shaped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, number, identity, n, hashes in _chunks(batch.column("text"), min_words) if len(batch) else ():
                keys, many = half_keys(hashes, n, near_words)
                of = pa.array(text)
                columns = [batch.column("doc").take(of), batch.column("k").take(of), number.astype(np.int32), identity[:, 0], identity[:, 1], n.astype(np.int32)]
                halves = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(many)).astype(np.int32)), pa.array(keys))
                columns += [halves, *(_sketches(hashes, n) if sketched else ())]
                yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=names)

    sketch = SKETCH if sketched else ()
    names = ["doc", "k", "line_no", "h1", "h2", "n", "halves", *sketch]
    kinds = [docs.schema["doc_id"].dataType, *(T.LongType(), T.IntegerType(), T.LongType(), T.LongType(), T.IntegerType()), T.ArrayType(T.LongType())]
    kinds += [T.LongType()] * len(sketch)
    rows = docs.filter(docs["text"].isNotNull()).select(docs["doc_id"].alias("doc"), text_key(docs["text"])[0].alias("k"), "text")
    found = rows.mapInArrow(shaped, T.StructType([T.StructField(*field) for field in zip(names, kinds)]))
    return found.select("h1", "h2", F.struct("doc", "k", "line_no").alias("place"), "n", "halves", *sketch)


def _line_words(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h1, h2, place, words) of the lines at the places of the stored table ``wanted``, one row each."""
    rows = docs.select(docs["doc_id"].alias("doc"), text_key(docs["text"])[0].alias("k"), "text")
    twice = not rows.groupBy("doc", "k").count().filter("count > 1").isEmpty()
    rows = rows.select("doc", "k", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    at = small(wanted.select("h1", "h2", F.col("place.doc").alias("d"), F.col("place.k").alias("x"), F.col("place.line_no").alias("i")))
    met = rows.join(at, F.col("doc").eqNullSafe(F.col("d")) & (F.col("k") == F.col("x")) & (F.col("line_no") == F.col("i")))
    met = met.select("h1", "h2", F.struct("doc", "k", "line_no").alias("place"), _words(F.col("line")).alias("words"))
    return met.groupBy("h1", "h2").agg(F.first("place").alias("place"), F.first("words").alias("words")) if twice else met


def within_one(x: Column, y: Column) -> Column:
    """Whether two word arrays lie within one edit."""
    shorter, longer = F.when(F.size(x) <= F.size(y), x).otherwise(y), F.when(F.size(x) <= F.size(y), y).otherwise(x)
    n, m = F.size(shorter), F.size(longer)
    odd = F.zip_with(shorter, F.slice(longer, F.lit(1), n), lambda a, b: a != b)
    first = F.array_position(odd, True).cast("int")
    replaced = F.slice(shorter, first + 1, n) == F.slice(longer, first + 1, m)
    added = F.slice(shorter, first, n) == F.slice(longer, first + 1, m)
    return (m - n <= 1) & ((first == 0) | F.when(m == n, replaced).otherwise(added))


def within_one_lines(places: DataFrame, docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(h1, h2) of the lines of ``places`` that an earlier line lies within one edit of, with that line's place."""
    distinct = places.groupBy("h1", "h2").agg(F.min("place").alias("place"), F.first("halves").alias("halves"))
    keys = distinct.select("h1", "h2", "place", F.explode("halves").alias("half"))
    busy = stored(keys.groupBy("half").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("half"), "halves")
    open_ = stored(keys.join(small(busy), "half").groupBy("h1", "h2").agg(F.first("place").alias("place")), "open")
    own = stored(_line_words(docs, open_), "candidates")

    filed = own.select("h1", "h2", "place", F.size("words").alias("n"), F.posexplode(_neighbourhoods("words")).alias("at", "key"))
    filed = filed.select("h1", "h2", "place", "key", F.when(F.col("at") < F.col("n"), F.col("at")).otherwise(-1).alias("at"))
    shared = filed.groupBy("key").agg(F.min("h1").alias("x"), F.max("h1").alias("y")).filter("x <> y").select("key")
    filed = stored(filed.join(small(stored(shared, "shared")), "key"), "filed")
    beside = filed.filter("at >= 0").groupBy("key", "at").agg(F.min("place").alias("partner"))
    whole = filed.filter("at < 0").groupBy("key").agg(F.min("place").alias("partner"))
    lacking = filed.filter("at >= 0").groupBy("key").agg(F.min("place").alias("partner"))
    met = (
        filed.join(beside, ["key", "at"]).select("h1", "h2", "place", "partner")
        .unionByName(filed.filter("at >= 0").join(whole, "key").select("h1", "h2", "place", "partner"))
        .unionByName(filed.filter("at < 0").join(lacking, "key").select("h1", "h2", "place", "partner"))
    )
    met = met.filter(F.col("partner") < F.col("place")).groupBy("h1", "h2", "partner").agg(F.first("place").alias("place"))
    mine = own.select("h1", "h2", F.col("words").alias("mine"))
    other = own.select(F.xxhash64("place").alias("p"), F.col("place").alias("partner_at"), F.col("words").alias("other"))
    pairs = met.withColumn("p", F.xxhash64("partner")).join(mine, ["h1", "h2"]).join(other, "p")
    pairs = pairs.filter(F.col("partner").eqNullSafe(F.col("partner_at")) & within_one(F.col("mine"), F.col("other")))
    return pairs.groupBy("h1", "h2").agg(F.min("partner").alias("partner"))


def distance(x: list[str], y: list[str], most: int | None = None) -> int:
    """Edit distance of two word sequences, a column of the table in the bits of one number (Myers, Hyyro); beyond ``most``, some number beyond it."""
    low, ends = 0, [len(x), len(y)]
    while low < min(ends) and x[low] == y[low]:
        low += 1
    while min(ends) > low and x[ends[0] - 1] == y[ends[1] - 1]:
        ends = [ends[0] - 1, ends[1] - 1]
    x, y = x[low : ends[0]], y[low : ends[1]]
    if not x or not y:
        return len(x) + len(y)
    at: dict[str, int] = {}
    for i, w in enumerate(x):
        at[w] = at.get(w, 0) | 1 << i
    full, last, out = (1 << len(x)) - 1, 1 << len(x) - 1, len(x)
    up, down = full, 0
    # A column lowers the last row by one at most.
    beyond = (len(x) + len(y) if most is None else most) + len(y)
    for w in y:
        if out > beyond:
            return out
        beyond -= 1
        match = at.get(w, 0)
        over = match | down
        match |= (((match & up) + up) ^ up) & full
        right = down | full & ~(match | up)
        left = up & match
        out += bool(right & last) - bool(left & last)
        right, left = (right << 1 | 1) & full, left << 1 & full
        up, down = left | full & ~(over | right), right & over
    return out


@F.pandas_udf(T.BooleanType())
def _within(mine: pd.Series, other: pd.Series, bound: pd.Series) -> pd.Series:
    return pd.Series([distance(x.tolist(), y.tolist(), k) <= k for x, y, k in zip(mine, other, bound)], dtype=bool)


@F.pandas_udf(T.BinaryType())
def _counts(lines: pd.Series) -> pd.Series:
    """How many words of a line fall to each of 64 counters, at most 255: an edit moves two by one at most."""
    at = [np.array([xxhash.xxh64_intdigest(w, 3) & 63 for w in words], np.int64) for words in lines]
    return pd.Series([np.minimum(np.bincount(a, minlength=64), 255).astype(np.uint8).tobytes() for a in at], dtype=object)


@F.pandas_udf(T.BooleanType())
def _counts_allow(mine: pd.Series, other: pd.Series, bound: pd.Series) -> pd.Series:
    x, y = (np.frombuffer(b"".join(c), np.uint8).reshape(-1, 64).astype(np.int16) for c in (mine, other))
    return pd.Series(np.abs(x - y).sum(1) <= 2 * bound.to_numpy())


def _run_words(n: int, per_words: int) -> int:
    return max(1, min(per_words - 1, n // (n // per_words + 1)))


def _runs(hashes: np.ndarray, n: np.ndarray, per_words: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, line, position, asked) of all runs of words to be found; asked are the k + 1 disjoint ones each line looks up."""
    starts = np.cumsum(n) - n
    line = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(hashes)) - starts[line]
    whole, edge = max(1, per_words - 1), per_words * max(2, per_words - 1)
    widths = {_run_words(m, per_words) for m in range(2 * per_words, edge)} | {whole}
    key_of, row_of, out, rows = {}, {}, [], 0
    for q in sorted(widths):
        keys = np.full(len(hashes), q, np.uint64)
        for i in range(q):
            keys = (keys ^ (keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + np.append(hashes[i:], np.zeros(min(i, len(hashes)), np.uint64))
        keys ^= keys >> np.uint64(29)
        key_of[q] = keys
        found = (place + q <= n[line]) & ((n[line] < edge) | (q == whole))
        row_of[q] = rows + np.cumsum(found) - 1
        out.append((keys[found], line[found], place[found]))
        rows += int(found.sum())
    asking = np.flatnonzero(n >= 2 * per_words)
    k = n[asking] // per_words
    width = np.minimum(whole, np.maximum(1, n[asking] // (k + 1)))
    of = np.repeat(np.arange(len(asking)), k + 1)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(k + 1) - (k + 1), k + 1)
    at = nth * n[asking][of] // (k[of] + 1)
    flat = starts[asking][of] + at
    keys = np.zeros(len(of), np.uint64)
    for q, all_keys in key_of.items():
        keys = np.where(width[of] == q, all_keys[flat], keys) if len(of) else keys
    for i in np.unique(of[np.isin(keys, hot)]) if len(hot) else ():
        q, first, size = int(width[i]), int(starts[asking[i]]), int(n[asking[i]])
        usable = ~np.isin(key_of[q][first : first + size - q + 1], hot)
        picked, free = [], 0
        for p in np.flatnonzero(usable).tolist():
            if p >= free and len(picked) <= k[i]:
                picked.append(p)
                free = p + q
        if len(picked) > k[i]:
            flat[of == i] = first + np.array(picked)
    asked = np.zeros(rows, bool)
    for q, row in row_of.items():
        asked[row[flat[width[of] == q]]] = True
    return *(np.concatenate(x) for x in zip(*out)), asked


def runs(lines: list[list[str]], per_words: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``_runs`` of lines given as words."""
    hashes = np.array([xxhash.xxh64_intdigest(w) for words in lines for w in words], np.uint64)
    return _runs(hashes, np.array([len(w) for w in lines], np.int64), per_words, hot)


def _deal(entries: list[np.ndarray], names: np.ndarray) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """(bucket, steps from key to key, names of lines, asked) of entries (key, line, not asked): each run of a line once, by bucket and key."""
    every = np.sort(np.concatenate(entries))
    every = every[np.append(True, np.diff(every >> np.uint64(1)) != 0)]
    line = (every >> np.uint64(1)) & np.uint64((1 << LINE_BITS) - 1)
    key = (every >> np.uint64(LINE_BITS + 1)) & np.uint64((1 << KEY_BITS) - 1)
    bucket = (every >> np.uint64(LINE_BITS + 1 + KEY_BITS)).astype(np.int64)
    name = np.ascontiguousarray(names[line.astype(np.int64)].reshape(-1, 1)).view(np.uint8).reshape(-1, 8)[:, : 8 - ID_SHIFT // 8]
    asked = (every & np.uint64(1)) == 0
    cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(every)]
    codec = pa.Codec("zstd", 1)
    for a, b in zip(cuts, cuts[1:]):
        steps = np.diff(key[a:b], prepend=np.uint64(0)).astype(np.uint32).view(np.uint8).reshape(-1, 4).T
        yield int(bucket[a]), codec.compress(steps.tobytes(), asbytes=True), name[a:b].tobytes(), np.packbits(asked[a:b]).tobytes()


def _dealt(steps: bytes, names: bytes, asked: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key inside the bucket, name of the line, asked) of what ``_deal`` packed."""
    size = len(names) // (8 - ID_SHIFT // 8)
    planes = np.frombuffer(pa.Codec("zstd").decompress(steps, 4 * size), np.uint8).reshape(4, size)
    key = np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).ravel(), dtype=np.uint32)
    name = np.zeros((size, 8), np.uint8)
    name[:, ID_SHIFT // 8 :] = np.frombuffer(names, np.uint8).reshape(size, -1)
    return key, name.view(np.int64).ravel() >> ID_SHIFT, np.unpackbits(np.frombuffer(asked, np.uint8), count=size).astype(bool)


def _shared_runs(docs: DataFrame, min_words: int, per_words: int, n_words: int, n_lines: int) -> DataFrame:
    """(key, id, asked) of the runs that one line asks for and another has; id is ``h1`` without its last bits."""
    step = max(1, n_lines // SAMPLE_LINES)
    rows = docs.filter(docs["text"].isNotNull())

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.array([], np.uint64)
        for batch in batches:
            for _, _, identity, n, hashes in _chunks(batch.column(0), min_words) if len(batch) else ():
                kept = identity[:, 0] % step == 0
                keys, line, _, _ = _runs(hashes[np.repeat(kept, n)], n[kept], per_words, none)
                seen = pd.DataFrame({"key": keys.view(np.int64), "h1": identity[kept, 0][line]}).drop_duplicates()
                yield pa.RecordBatch.from_pandas(seen, preserve_index=False)

    # Whole documents are sampled first, so that few are taken apart; a line of theirs counts once.
    part = rows.filter(F.pmod(F.xxhash64("text"), F.lit(max(1, step // 4))) == 0).select("text")
    step = 4 if step >= 8 else step
    often = part.mapInArrow(counted, "key long, h1 long").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    rows_hot = often.filter(F.col("n") > max(20, HOT_SHARE * min(n_lines, SAMPLE_LINES))).select("key").collect()
    hot = np.array(sorted(r.key for r in rows_hot), np.int64).view(np.uint64)
    buckets = min(1 << BUCKET_BITS, max(12, n_words // BUCKET_RUNS))
    kinds = pa.schema([("bucket", pa.int32()), ("steps", pa.binary()), ("names", pa.binary()), ("asked", pa.binary())])

    def dealt(entries: list[np.ndarray], names: list[np.ndarray]) -> pa.RecordBatch:
        columns = zip(*_deal(entries, np.concatenate(names) >> ID_SHIFT))
        return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(columns, kinds)], schema=kinds)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, entries, names, many, held = set(), [], [], 0, 0
        for batch in batches:
            for _, _, identity, n, hashes in _chunks(batch.column(0), min_words) if len(batch) else ():
                new = np.array([not (h in seen or seen.add(h)) for h in identity[:, 0].tolist()], bool)
                if many and held + len(new) > 1 << LINE_BITS:
                    yield dealt(entries, names)
                    entries, names, many, held = [], [], 0, 0
                keys, line, _, asked = _runs(hashes[np.repeat(new, n)], n[new], per_words, hot)
                # Bucket and key are the leading bits of the product, so that what is sorted by it is sorted by bucket.
                key = ((keys >> np.uint64(16)) * np.uint64(buckets)) >> np.uint64(48 - KEY_BITS)
                entries.append((((key << np.uint64(LINE_BITS)) | (line + held).astype(np.uint64)) << np.uint64(1)) | (~asked).astype(np.uint64))
                names.append(identity[new, 0])
                many, held = many + len(keys), held + int(new.sum())
                if many >= DEALT_RUNS:
                    yield dealt(entries, names)
                    entries, names, many, held = [], [], 0, 0
                    if len(seen) > BROADCAST_ROWS:
                        seen = set()
        if many:
            yield dealt(entries, names)

    def met(group: pd.DataFrame) -> pd.DataFrame:
        keys, ids, asked = (np.concatenate(x) for x in zip(*(_dealt(*row) for row in zip(group["steps"], group["names"], group["asked"]))))
        order = np.argsort(keys, kind="stable")
        keys, ids, asked = keys[order], ids[order], asked[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        good = (np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first)) & np.logical_or.reduceat(asked, first)
        kept = np.repeat(good, np.diff(np.append(first, len(keys))))
        keys, ids, asked = (int(group["bucket"].iloc[0]) << KEY_BITS) + keys[kept].astype(np.int64), ids[kept], asked[kept]
        order = np.lexsort((~asked, ids, keys))
        out = pd.DataFrame({"key": keys[order], "id": ids[order], "asked": asked[order]})
        return out.drop_duplicates(["key", "id"])

    found = rows.select("text").mapInArrow(packed, "bucket int, steps binary, names binary, asked binary")
    return found.groupBy("bucket").applyInPandas(met, "key long, id long, asked boolean")


def _filed(shared: DataFrame, first: DataFrame, settled: DataFrame, *columns: str) -> DataFrame:
    """(key, asked, settled, place, h1, n) and the named columns of every line with a shared run."""
    marked = first.join(small(settled.withColumn("settled", F.lit(True))), ["h1", "h2"], "left")
    return shared.join(marked.select("id", F.col("settled").isNotNull().alias("settled"), "place", "h1", "n", *columns), "id").drop("id")


def _first_pairs(filed: DataFrame, per_words: int) -> DataFrame:
    """(x, y), both ``h1``, the longer line first: each open line with the earliest line of each of its runs, however many lines share the run."""
    met = filed.withColumn("e", F.min(F.struct("place", "h1", "n")).over(Window.partitionBy("key")))
    met = met.filter(~F.col("settled") & (F.col("h1") != F.col("e.h1")) & (F.abs(F.col("n") - F.col("e.n")) <= F.floor(F.greatest("n", "e.n") / per_words)))
    longer = F.col("n") >= F.col("e.n")
    return met.select(F.when(longer, F.col("h1")).otherwise(F.col("e.h1")).alias("x"), F.when(longer, F.col("e.h1")).otherwise(F.col("h1")).alias("y")).distinct()


def _pairs(filed: DataFrame, per_words: int) -> DataFrame:
    """(x, y), both ``h1``, the longer line first, of lines with a run in common that the longer one asks for, one of them open."""
    last = F.max(F.when(~F.col("settled"), F.col("place"))).over(Window.partitionBy("key"))
    # A settled line only matters to a later open one.
    rows = filed.withColumn("last", last).filter(~F.col("settled") | (F.col("place") < F.col("last"))).drop("last", "place")
    other = rows.select("key", F.col("settled").alias("s"), F.col("h1").alias("y"), F.col("n").alias("m"), *(F.col(c).alias(f"o{c}") for c in COUNTERS))
    met = rows.filter("asked").join(other, "key")
    bound = F.floor(F.col("n") / per_words)
    met = met.filter((F.col("h1") != F.col("y")) & (F.col("n") - F.col("m")).between(0, bound) & ~(F.col("settled") & F.col("s")))
    met = met.filter(beyond([F.col(c) for c in COUNTERS], [F.col(f"o{c}") for c in COUNTERS]) <= bound)
    return met.select(F.col("h1").alias("x"), "y").distinct()


def _close(pairs: DataFrame, first: DataFrame, settled: DataFrame, per_words: int) -> DataFrame:
    """(h1, h2, place, p1, p2, partner, bound) of the pairs whose sketches allow the bound and whose later line, named first, is open."""
    light = first.select("h1", "n", F.struct("place", "h1", "h2").alias("line"), *SKETCH)
    other = light.select(F.col("h1").alias("y"), F.col("line").alias("partner"), *(F.col(c).alias(f"o{c}") for c in SKETCH))
    met = pairs.join(light.withColumnRenamed("h1", "x"), "x").join(other, "y").withColumn("bound", F.floor(F.col("n") / per_words).cast("int"))
    turned = functools.reduce(Column.__add__, [F.bit_count(F.col(c).bitwiseXOR(F.col(f"o{c}"))) for c in TURNED])
    met = met.filter(turned <= 2 * F.col("bound")).filter(beyond([F.col(c) for c in COUNTERS], [F.col(f"o{c}") for c in COUNTERS]) <= F.col("bound"))
    met = met.select(F.greatest("line", "partner").alias("line"), F.least("line", "partner").alias("partner"), "bound")
    met = met.select("line.h1", "line.h2", "line.place", F.col("partner.h1").alias("p1"), F.col("partner.h2").alias("p2"), F.col("partner.place").alias("partner"), "bound")
    return met.join(small(settled), ["h1", "h2"], "left_anti")


def _verified(pairs: DataFrame, first: DataFrame, docs: DataFrame, settled: DataFrame, per_words: int) -> DataFrame:
    """(h1, h2, partner): the later lines of ``pairs`` whose words lie within the bound of the earlier one's, with the earliest such place."""
    close = stored(_close(pairs, first, settled, per_words), "close")
    wanted = close.select("h1", "h2", "place").unionByName(close.select(F.col("p1").alias("h1"), F.col("p2").alias("h2"), F.col("partner").alias("place")))
    own = stored(_line_words(docs, stored(wanted.distinct(), "wanted")).withColumn("counts", _counts("words")), "run_words")
    mine = small(own.select("h1", "h2", F.col("counts").alias("mine")))
    other = small(own.select(F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("counts").alias("other")))
    close = close.join(mine, ["h1", "h2"]).join(other, ["p1", "p2"]).filter(_counts_allow("mine", "other", "bound"))
    close = small(stored(close.select("h1", "h2", "p1", "p2", "partner", "bound"), "closer"))
    met = own.select("h1", "h2", F.col("words").alias("mine")).join(close, ["h1", "h2"])
    met = met.join(own.select(F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("words").alias("other")), ["p1", "p2"])
    return met.filter(_within("mine", "other", "bound")).groupBy("h1", "h2").agg(F.min("partner").alias("partner"))


def _least_words(near_words: int, per_words: int) -> int:
    """Words of the shortest line that more than one edit may lead to."""
    return max(1, near_words, 2 * per_words - 2)


def within_more_lines(places: DataFrame, docs: DataFrame, near: DataFrame, min_words: int, near_words: int, per_words: int) -> DataFrame:
    """(h1, h2) of lines of 2 * ``per_words`` words and more that an earlier line lies within the bound of, beyond those of ``near``."""
    least = _least_words(near_words, per_words)
    long = places.filter(F.col("n") >= least)
    total = long.agg(F.sum("n").alias("words"), F.count(F.lit(1)).alias("lines")).first()
    shared = stored(_shared_runs(docs, max(min_words, least), per_words, total["words"] or 0, total["lines"]), "runs")
    ids = stored(shared.select("id").distinct(), "run_lines")
    first = long.withColumn("id", F.shiftright("h1", ID_SHIFT)).join(small(ids), "id").groupBy("id", "h1", "h2")
    first = stored(first.agg(F.min("place").alias("place"), *(F.first(c).alias(c) for c in ("n", *SKETCH))), "run_places")
    settled = near.select("h1", "h2")
    pairs = stored(_first_pairs(_filed(shared, first, settled), per_words), "first_pairs")
    found = stored(_verified(pairs, first, docs, settled, per_words), "near_first")
    settled = settled.unionByName(found.select("h1", "h2"))
    pairs = stored(_pairs(_filed(shared, first, settled, *COUNTERS), per_words), "pairs")
    return found.unionByName(stored(_verified(pairs, first, docs, settled, per_words), "near_rest"))


def near_lines(places: DataFrame, docs: DataFrame, min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS, per_words: int | None = PER_WORDS) -> DataFrame:
    """(h1, h2) of the lines of ``places`` that an earlier line lies within the bound of, with the place of one such line."""
    if per_words is None:
        return within_one_lines(places, docs, min_words)
    one = stored(within_one_lines(places, docs, min_words), "near_one")
    return one.unionByName(within_more_lines(places, docs, one, min_words, near_words, per_words))


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS, per_words: int | None = PER_WORDS) -> DataFrame:
    """(doc, k, line_no, near): the lines to remove; near tells edits from an exact repetition."""
    places = stored(_shapes(docs, min_words, near_words, sketched=per_words is not None), "lines")
    near = near_lines(places, docs, min_words, near_words, per_words).select("h1", "h2", F.lit(True).alias("near"))
    firsts = places.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    going = firsts.join(near, ["h1", "h2"], "left").filter("n > 1 or near")
    going = small(stored(going.select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near")), "going"))
    gone = places.join(going, ["h1", "h2"]).filter(F.col("near") | (F.col("place") > F.col("first")))
    return gone.select("place.doc", "place.k", "place.line_no", "near")


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS, per_words: int | None = PER_WORDS) -> DataFrame:
    """Columns row (the document with its remaining text), n_lines, n_removed, n_near and emptied of every row."""
    gone = repeated_lines(docs, min_words, near_words, per_words)
    gone = gone.groupBy("doc", "k").agg(F.collect_set("line_no").alias("gone"), F.sum(F.col("near").cast("long")).alias("n_near"))
    gone = stored(gone, "gone")
    size = gone.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.size("gone")), F.lit(0)).alias("numbers")).first()
    gone = F.broadcast(gone) if size["rows"] + size["numbers"] // NUMBERS_A_ROW <= BROADCAST_ROWS else gone
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].alias("d"), text_key(docs["text"])[0].alias("x"))
    rows = rows.join(gone, F.col("d").eqNullSafe(F.col("doc")) & (F.col("x") == F.col("k")), "left")
    # A filter on the result would be pushed below the projection and run a deterministic function twice, in twice the workers.
    rows = rows.withColumn("cut", _without.asNondeterministic()(F.when(F.col("gone").isNotNull(), F.col("row.text")), F.col("gone")))
    text = F.coalesce("cut", "row.text")
    changed = {"text": text}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(F.col("gone").isNull(), F.col("row.n_chars")).otherwise(F.length(text).cast(kind))
    new = F.struct(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
    return rows.select(
        new.alias("row"),
        F.when(F.col("row.text").isNull(), 0).otherwise(F.size(F.split("row.text", "\n"))).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.coalesce(~F.col("cut").rlike(r"\S"), F.lit(False)).alias("emptied"),
    )


def keep_lines(docs: DataFrame, min_words: int = MIN_WORDS, per_words: int | None = None) -> DataFrame:
    """``docs`` without repeated lines, one edit at any length by default, and without the documents that nothing is left of."""
    return dedup(docs, min_words, per_words=per_words).filter(~F.col("emptied")).select("row.*")
