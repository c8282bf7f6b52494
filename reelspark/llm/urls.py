"""URL filtering: rules first, then a character language-model ratio, in DataFrame functions alone.

Urls that a rule decides teach two variable-order Markov models over characters, one of accepted and one of rejected urls.
An order-k probability is Witten-Bell smoothed towards order k - 1, down to a uniform base; an unseen context passes on
the shorter one's probability. A url's score is the mean over its characters of the difference of the two log-likelihoods. The
cut is calibrated on a fifth of the ruled urls, held out by url: where the normal curves of both classes' scores have
the same tail.

Counts are kept per (context, character) after a map-side sum, so a common host is one row per task. Characters are those
of the lower-cased url with every digit as 0. Defined results: null urls and urls without :// have empty host and path; an
empty or null url scores 0; without urls of both classes everything unruled is allowed; repeated rows and null ids are judged
like any row; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.llm.common import ascii_lower, small, stored, text_key

#: Characters of context; characters that the base distribution spreads over.
ORDER, ALPHABET = 4, 256
PAD = "\u0002"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, _PARTS, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest (verdict, host, path) rule that fits, as struct (rule, verdict); null if none does."""
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    table = F.array(*[F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"), F.lit(h).alias("h"), F.lit(p).alias("p")) for v, h, p in longest])
    fits = F.filter(table, lambda r: ((host == r["h"]) | F.endswith(host, F.concat(F.lit("."), r["h"]))) & F.startswith(path, r["p"]))
    return F.get(fits, F.lit(0))


def _signs(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), "[0-9]", "0")


def _grams(signs: Column) -> Column:
    """Each character of a text with the ORDER characters before it."""
    padded = F.concat(F.lit(PAD * ORDER), signs)
    places = F.sequence(F.lit(1), F.length(signs))
    return F.when(F.length(signs) > 0, F.transform(places, lambda i: F.substring(padded, i, F.lit(ORDER + 1)))).otherwise(F.array().cast("array<string>"))


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(gram, good, bad): how often each gram occurs in accepted and rejected texts (signs, good)."""
    rows = labelled.select("good", F.explode(_grams(F.col("signs"))).alias("gram"))
    return rows.groupBy("gram").agg(F.sum(F.col("good").cast("long")).alias("good"), F.sum((~F.col("good")).cast("long")).alias("bad"))


def _orders(grams: DataFrame) -> DataFrame:
    """Each gram with its suffixes: k characters of context and the character."""
    orders = F.transform(F.sequence(F.lit(0), F.lit(ORDER)), lambda k: F.struct(k.alias("k"), F.right("gram", k + 1).alias("cell")))
    return grams.select("*", F.inline(orders))


def _context() -> Column:
    return F.expr("substring(cell, 1, length(cell) - 1)").alias("context")


def ratios(grams: DataFrame, counts: DataFrame) -> DataFrame:
    """(gram, ratio): log-likelihood difference of a gram's last character given the ones before, for every row of ``grams``."""
    cells = stored(_orders(counts).groupBy("k", "cell").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")), "cells")
    seen = lambda c: F.sum((F.col(c) > 0).cast("long"))
    contexts = cells.groupBy("k", _context()).agg(F.sum("good").alias("n_good"), seen("good").alias("t_good"), F.sum("bad").alias("n_bad"), seen("bad").alias("t_bad"))
    rows = _orders(grams).select("gram", "k", "cell", _context()).join(cells, ["k", "cell"], "left").join(contexts, ["k", "context"], "left")
    names = ["good", "n_good", "t_good", "bad", "n_bad", "t_bad"]
    steps = F.sort_array(F.collect_list(F.struct("k", *[F.coalesce(c, F.lit(0)).alias(c) for c in names])))

    def chance(which: str) -> Column:
        return F.aggregate(
            "steps",
            F.lit(1.0 / ALPHABET),
            lambda p, s: F.when(s[f"n_{which}"] > 0, (s[which] + s[f"t_{which}"] * p) / (s[f"n_{which}"] + s[f"t_{which}"])).otherwise(p),
        )

    return rows.groupBy("gram").agg(steps.alias("steps")).select("gram", (F.log(chance("good")) - F.log(chance("bad"))).alias("ratio"))


def scored(texts: DataFrame, counts: DataFrame) -> DataFrame:
    """(x, y, score): mean ratio of each distinct text of ``texts`` (signs), by its key."""
    x, y = text_key(F.col("signs"))
    grams = texts.select(x.alias("x"), y.alias("y"), F.explode(_grams(F.col("signs"))).alias("gram"))
    grams = grams.groupBy("x", "y", "gram").agg(F.count(F.lit(1)).alias("n"))
    table = small(stored(ratios(texts.select(F.explode(_grams(F.col("signs"))).alias("gram")).distinct(), counts), "ratios"))
    rows = grams.join(table, "gram").groupBy("x", "y")
    return rows.agg((F.sum(F.col("n") * F.col("ratio")) / F.sum("n")).alias("score"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """A row for each row of ``pages`` (page_id, url): page_id, host, path, rule, verdict, score."""
    url = pages["url"]
    rows = pages.select(pages["page_id"], url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"), _signs(url).alias("signs"))
    rows = stored(rows.withColumn("r", matching_rule(F.col("host"), F.col("path"), rules)), "urls")
    ruled = rows.filter("r is not null").select("url", "signs", (F.col("r.verdict") == "allow").alias("good"))
    held = F.pmod(F.xxhash64("url"), F.lit(5)) == 0
    counts = stored(gram_counts(ruled.filter(~held)), "grams")
    x, y = text_key(F.col("signs"))
    scores = stored(scored(rows.select("signs").distinct(), counts), "scores")
    judged = rows.withColumns({"x": x, "y": y}).join(scores, ["x", "y"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    held_out = judged.filter(held & F.col("r").isNotNull()).groupBy((F.col("r.verdict") == "allow").alias("good"))
    tails = {r["good"]: (r["m"], r["s"] or 0.0) for r in held_out.agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s")).collect()}
    cut = None
    if len(tails) == 2:
        (a, sa), (b, sb) = tails[True], tails[False]
        cut = (a * sb + b * sa) / (sa + sb) if sa + sb else (a + b) / 2
    verdict = F.lit("allow") if cut is None else F.when(F.col("score") >= cut, "allow").otherwise("block")
    return judged.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", verdict).alias("verdict"), "score")
