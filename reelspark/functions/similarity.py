"""Text similarity.

``indel_ratio`` is 2*LCS/(len a + len b). Against a keyword known up front the LCS is taken bit-parallel: one
BIGINT holds the row of the dynamic programme, so a text costs one step per character; longer keywords take as many
BIGINTs as they need, with the carry handed from one to the next. Everything stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Keyword length a signed 64-bit row can hold with one bit spare for the carry.
WORD_BITS = 61


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _ratio(lcs: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * lcs / total)


def indel_ratio(a: Column, b: Column) -> Column:
    """Normalised Indel similarity of two columns; two empty texts are equal (1.0)."""
    lefts, rights = _chars(a), _chars(b)
    start = F.array_repeat(F.lit(0), F.size(rights) + 1)

    def next_row(row: Column, ch: Column) -> Column:
        # cells are appended left to right; the last appended cell is the left neighbour
        return F.aggregate(
            F.sequence(F.lit(1), F.size(rights)),
            F.array(F.lit(0)),
            lambda cells, j: F.concat(
                cells,
                F.array(
                    F.when(F.element_at(rights, j) == ch, F.element_at(row, j) + 1).otherwise(
                        F.greatest(F.element_at(row, j + 1), F.element_at(cells, -1))
                    )
                ),
            ),
        )

    lcs = F.when(
        (F.length(a) == 0) | (F.length(b) == 0), F.lit(0)
    ).otherwise(F.element_at(F.aggregate(lefts, start, next_row), -1))
    return F.when(a == b, F.lit(1.0)).otherwise(_ratio(lcs, F.length(a) + F.length(b)))


def keyword_struct(keyword: str, position: int) -> Column:
    """A keyword prepared for ``keyword_ratio``: normalised text, length, and where each character occurs."""
    norm = keyword.lower()
    masks: dict[str, int] = {}
    if len(norm) <= WORD_BITS:
        for i, ch in enumerate(norm):
            masks[ch] = masks.get(ch, 0) | (1 << i)
    pairs = [F.struct(F.lit(c).alias("ch"), F.lit(m).cast("bigint").alias("bits")) for c, m in sorted(masks.items())]
    masks_col = F.map_from_entries(F.array(*pairs)) if pairs else F.from_json(F.lit("{}"), "map<string,bigint>")
    return F.struct(
        F.lit(position).alias("kw_idx"),
        F.lit(keyword).alias("keyword"),
        F.lit(norm).alias("norm"),
        F.lit(len(norm)).alias("n"),
        masks_col.alias("masks"),
    )


def keyword_masks(norm: Column) -> Column:
    """map<character, bit positions> of a keyword column (empty for keywords beyond one word)."""
    chars = _chars(norm)
    bits = lambda c: F.aggregate(
        F.sequence(F.lit(0), F.size(chars) - 1),
        F.lit(0).cast("bigint"),
        lambda acc, i: F.when(
            F.get(chars, i) == c, acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i))
        ).otherwise(acc),
    )
    entries = F.transform(F.array_distinct(chars), lambda c: F.struct(c.alias("ch"), bits(c).alias("bits")))
    return F.when(
        F.length(norm).between(1, WORD_BITS), F.map_from_entries(entries)
    ).otherwise(F.from_json(F.lit("{}"), "map<string,bigint>"))


def prepared(keyword: Column, position: Column) -> Column:
    """``keyword_struct`` of a keyword column."""
    norm = F.lower(keyword)
    return F.struct(
        position.cast("int").alias("kw_idx"), keyword.alias("keyword"), norm.alias("norm"), F.length(norm).alias("n"), keyword_masks(norm).alias("masks")
    )


def _wide_lcs(text: Column, norm: Column) -> Column:
    """LCS of a text and a keyword of any length, its row in words of ``WORD_BITS`` bits."""
    zero, ones = F.lit(0).cast("bigint"), F.lit((1 << WORD_BITS) - 1)
    starts = F.sequence(F.lit(0), F.floor((F.length(norm) - 1) / WORD_BITS).cast("int"))
    blocks = F.transform(starts, lambda b: F.substring(norm, b * WORD_BITS + 1, WORD_BITS))
    words = F.transform(blocks, lambda p: F.struct(keyword_masks(p).alias("masks"), F.length(p).alias("n")))

    def fold(kw: Column) -> Column:
        def step(rows: Column, ch: Column) -> Column:
            def word(acc: Column, w: Column) -> Column:
                row, hits = w["row"], F.coalesce(F.try_element_at(w["masks"], ch), zero)
                total = row + row.bitwiseAND(hits) + acc["carry"]
                new = total.bitwiseAND(ones).bitwiseOR(row.bitwiseAND(F.bitwise_not(hits)))
                return F.struct(F.shiftright(total, WORD_BITS).alias("carry"), F.concat(acc["rows"], F.array(new)).alias("rows"))

            paired = F.zip_with(rows, kw, lambda r, k: F.struct(r.alias("row"), k["masks"].alias("masks")))
            start = F.struct(zero.alias("carry"), F.array().cast("array<bigint>").alias("rows"))
            return F.aggregate(paired, start, word)["rows"]

        rows = F.aggregate(_chars(text), F.transform(kw, lambda k: ones), step)
        unset = F.zip_with(rows, kw, lambda r, k: k["n"] - F.bit_count(r.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), k["n"]) - 1)))
        return F.aggregate(unset, F.lit(0), lambda a, b: a + b)

    # the masks are bound once for all steps
    return F.get(F.transform(F.array(words), fold), F.lit(0))


def keyword_ratio(text: Column, keyword: Column) -> Column:
    """Indel ratio of a normalised text against a prepared keyword struct."""
    n = keyword["n"]
    ones = F.call_function("shiftleft", F.lit(1).cast("bigint"), n) - 1
    zero = F.lit(0).cast("bigint")

    def step(row: Column, hits: Column) -> Column:
        return (row + row.bitwiseAND(hits)).bitwiseAND(full).bitwiseOR(row.bitwiseAND(F.bitwise_not(hits)))

    # an empty piece of the split matches nothing and leaves the row as it is; bits above the keyword's never reach down
    full = F.lit((1 << WORD_BITS) - 1)
    hits = F.transform(F.split(text, ""), lambda ch: F.coalesce(F.try_element_at(keyword["masks"], ch), zero))
    row = F.aggregate(hits, ones, step)
    fast = _ratio((n - F.bit_count(row.bitwiseAND(ones))).cast("double"), F.length(text) + n)
    return (
        F.when(text == keyword["norm"], F.lit(1.0))
        .when((n == 0) | (F.length(text) == 0), F.lit(0.0))
        .when(n <= WORD_BITS, fast)
        .otherwise(_ratio(_wide_lcs(text, keyword["norm"]), F.length(text) + n))
    )


def ratio_ceiling(text: Column, keyword: Column) -> Column:
    """Upper bound of the ratio from the lengths alone: 2*min/(sum)."""
    total = F.length(text) + keyword["n"]
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * F.least(F.length(text), keyword["n"]) / total)


@F.pandas_udf(DoubleType())
def matching_blocks_ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Matching-blocks ratio of two texts, lower-cased; an empty side gives 0. Repeats are scored once per batch."""

    def score(a: str | None, b: str | None) -> float:
        return SequenceMatcher(None, a.lower(), b.lower()).ratio() if a and b else 0.0

    for left, right in pairs:
        seen: dict[tuple, float] = {}
        for key in zip(left, right):
            if key not in seen:
                seen[key] = score(*key)
        yield pd.Series([seen[key] for key in zip(left, right)], dtype="float64")
