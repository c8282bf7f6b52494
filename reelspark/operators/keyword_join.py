"""Similarity join of texts with a keyword table of any length.

Short configured lists travel as one array (``text.keywords_from``). A table goes through an equi-join instead: a word is
the set of its characters, each marked with its how-manieth occurrence it is, so the marks two words share bound
their longest common subsequence. A ratio of at least t asks for ``t * (n + m) / 2`` shared marks; hence, with the
marks of both words in one fixed order, the leading ``n - needed + 1`` marks of the text and those of the keyword meet. Texts and
keywords are joined on (mark, keyword length); lengths out of reach never become keys. A pair is taken at the
first mark it shares, once, if neither 64 bits of marks nor the Levenshtein distance rule it out already, and only then the
subsequence is computed.

Rare marks come first: the ``RANKED`` most frequent marks of the table are put behind all others, which steers the size of
keys, never the result, and gives each of them a bit of its own. The prepared table is stored once and measured; it travels to every task below ``TRAVEL_BYTES``,
beyond that the texts are dealt into ``PARTS`` salts and the keywords copied to each.

Defined results: an empty text meets only an empty keyword (ratio 1); NULL texts and keywords meet nothing; words that
share no character have no row, whatever the threshold; repeated keywords are compared on their own, and the lowest
``kw_idx`` wins ties.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.functions import similarity
from reelspark.session import durable

TRAVEL_BYTES = 32 << 20
PARTS = 16
RANKED = 64
#: Ratios at which texts are settled one after the other when no threshold is asked for.
LEVELS = (0.7, 0.45, 0.0)
_EPS = 1e-9


def marks(norm: Column) -> Column:
    """Characters with the number of their occurrence; an empty text has one empty mark."""
    chars = F.array_sort(F.filter(F.split(norm, ""), lambda c: c != ""))
    counted = F.transform(F.array(chars), lambda s: F.transform(s, lambda c, i: F.concat(c, (i + 1 - F.array_position(s, c)).cast("string"))))
    return F.when(norm == "", F.array(F.lit(""))).otherwise(F.get(counted, F.lit(0)))


def _in_order(found: Column, ranks: Column) -> Column:
    ranked = F.transform(found, lambda m: F.struct(F.coalesce(F.try_element_at(ranks, m), F.lit(0)).alias("rank"), m.alias("mark")))
    return F.transform(F.sort_array(ranked), lambda r: r["mark"])


def _bits(found: Column, ranks: Column) -> Column:
    """A bit for each ranked mark, one by hash for the others."""
    one = F.lit(1).cast("bigint")
    bit = lambda m: F.coalesce(F.try_element_at(ranks, m) - 1, F.pmod(F.xxhash64(m), F.lit(RANKED)).cast("int"))
    return F.aggregate(found, F.lit(0).cast("bigint"), lambda acc, m: acc.bitwiseOR(F.call_function("shiftleft", one, bit(m))))


def _needed(n: Column, m: Column, threshold: float) -> Column:
    return F.greatest(F.lit(1), F.ceil(threshold * (n + m) / 2 - _EPS).cast("int"))


def _leading(found: Column, n: Column, needed: Column) -> Column:
    return F.slice(found, F.lit(1), F.greatest(F.lit(1), n - needed + 1))


@dataclass(frozen=True)
class KeywordTable:
    """Keywords prepared by ``prepare``: ``rows`` (kw_idx, keyword, norm, n, masks, marks, bits) and whether they travel."""

    rows: DataFrame
    travels: bool
    ranks: Column
    lengths: Column


def prepare(table: DataFrame, travel_bytes: int = TRAVEL_BYTES) -> KeywordTable:
    """``table(kw_idx, keyword)`` for ``similar`` and ``best``; written once, its bytes measured."""
    norm = F.lower("keyword")
    rows = table.filter(F.col("keyword").isNotNull()).select(F.col("kw_idx").cast("bigint").alias("kw_idx"), "keyword", norm.alias("norm"), F.length(norm).alias("n"))
    rows = durable(rows.withColumn("masks", similarity.keyword_masks(F.col("norm"))).withColumn("marks", marks(F.col("norm"))))
    often = rows.select(F.explode("marks").alias("mark")).groupBy("mark").agg(F.count(F.lit(1)).alias("c"))
    often = often.orderBy(F.col("c").desc(), "mark").limit(RANKED)
    in_turn = F.transform(F.sort_array(F.collect_list(F.struct("c", "mark"))), lambda x, i: F.struct(x["mark"], (i + 1).alias("rank")))
    ranks = often.agg(F.map_from_entries(in_turn).alias("r")).scalar()
    lengths = rows.select("n").distinct().agg(F.sort_array(F.collect_list("n")).alias("l")).scalar()
    text_bytes, mark_bytes = F.octet_length("keyword") + F.octet_length("norm"), F.size("marks") * 24 + F.size("masks") * 32
    size = rows.agg(F.coalesce(F.sum(text_bytes + mark_bytes + 64), F.lit(0))).first()[0]
    return KeywordTable(rows, size * 2 <= travel_bytes, ranks, lengths)


def similar(texts: DataFrame, kws: KeywordTable, threshold: float) -> DataFrame:
    """(norm, kw_idx, keyword, similarity) of every text of ``texts(norm)`` and keyword with a ratio of at least ``threshold``, above 0."""
    t = max(float(threshold), 0.0)
    n, m = F.col("text_n"), F.col("m")
    # words are few bytes but meet many: left to size-based coalescing they would end in one task; by the plain column the
    # shuffle would merge with that of a distinct before it, which is coalesced
    partitions = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = texts.filter(F.col("norm").isNotNull()).repartition(partitions, F.xxhash64("norm")).select("norm", F.length("norm").alias("text_n"), kws.lengths.alias("lengths"), kws.ranks.alias("ranks"))
    reach = F.filter("lengths", lambda m: 2 * F.least(n, m) >= t * (n + m) - _EPS)
    asked = asked.withColumn("reach", reach).filter(F.size("reach") > 0)
    asked = asked.withColumn("text_marks", _in_order(marks(F.col("norm")), F.col("ranks")))
    asked = asked.withColumn("text_bits", _bits(F.col("text_marks"), F.col("ranks")))
    asked = asked.select("norm", "text_n", "text_marks", "text_bits", F.explode("reach").alias("m"))
    asked = asked.withColumn("text_lead", _leading(F.col("text_marks"), n, _needed(n, m, t))).drop("text_marks")
    asked = asked.select("norm", "text_n", "text_bits", "text_lead", "m", F.posexplode("text_lead").alias("at", "mark"))
    asked = asked.withColumn("earlier", F.slice("text_lead", F.lit(1), F.col("at"))).drop("text_lead")

    size = F.col("n")
    shortest = F.greatest(F.lit(0), F.ceil(t * size / (2 - t) - _EPS).cast("int"))
    held = kws.rows.withColumn("ranks", kws.ranks).withColumn("marks", _in_order(F.col("marks"), F.col("ranks")))
    held = held.withColumn("lead", _leading(F.col("marks"), size, _needed(shortest, size, t)))
    kw = F.struct("kw_idx", "keyword", "norm", "n", "masks").alias("kw")
    held = held.withColumn("bits", _bits(F.col("marks"), F.col("ranks")))
    held = held.select(kw, "bits", "lead", F.col("n").alias("m"), F.explode("lead").alias("mark"))

    text_only = F.bit_count(F.col("text_bits").bitwiseAND(F.bitwise_not(F.col("bits"))))
    kw_only = F.bit_count(F.col("bits").bitwiseAND(F.bitwise_not(F.col("text_bits"))))
    possible = F.least(n - text_only, m - kw_only) >= t * (n + m) / 2 - _EPS
    # replacing a character costs the Levenshtein distance 1 and the ratio 2, so that distance is never the greater one
    near = F.levenshtein("norm", "kw.norm") <= (1 - t) * (n + m) + _EPS
    once = (F.col("at") == 0) | ~F.arrays_overlap("earlier", "lead")
    keys = ["mark", "m"]
    if kws.travels:
        held = F.broadcast(held)
    else:
        asked = asked.withColumn("salt", F.pmod(F.xxhash64("norm"), F.lit(PARTS)).cast("int"))
        held = held.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        keys = [*keys, "salt"]
    met = asked.join(held, keys).filter(possible & near & once)
    # an outer generator keeps the ratio behind the cheap conditions and has it computed once
    scored = met.select("norm", "kw.kw_idx", "kw.keyword", F.explode_outer(F.array(similarity.keyword_ratio(F.col("norm"), F.col("kw")))).alias("similarity"))
    return scored.filter((F.col("similarity") >= t) & (F.col("similarity") > 0))


def best(texts: DataFrame, kws: KeywordTable, threshold: float | None) -> DataFrame:
    """(norm, keyword, similarity): the best keyword of each distinct text, the lowest kw_idx on ties.

    Without a threshold texts are settled level by level, so that only the few without a good keyword meet many.
    """

    def at(some: DataFrame, level: float) -> DataFrame:
        top = F.max(F.struct("similarity", (-F.col("kw_idx")).alias("rank"), "keyword"))
        return similar(some, kws, level).groupBy("norm").agg(top.alias("b")).select("norm", "b.keyword", "b.similarity")

    if threshold is not None:
        return at(texts, threshold)
    open_, found = durable(texts.select("norm").distinct()), None
    for level in LEVELS:
        hits = durable(at(open_, level))
        found = hits if found is None else found.unionByName(hits)
        open_ = open_.join(hits.select("norm"), "norm", "left_anti")
    return found
