"""Language identification by multilingual mixture inference.

A document is a mixture of languages. Each language has a distribution over character trigrams, counted over every
learning document; expectation-maximisation finds the proportions under which a document's trigrams are likeliest.
Of the nested language sets (the likeliest language, the two likeliest, ...) the one with the best penalised
likelihood stands, so a few foreign words do not make a document bilingual.

Defined results: null or letterless text is ``und`` with score 0 and no proportions; ties go to the language that sorts
first; rows of the learning table without text or language teach nothing; with nothing learned every text is ``und``.
Repeated rows are judged alike, other columns pass through.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Trigrams are hashed into this many bits; the model holds one row of floats for each bucket.
BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
#: Characters that are turned into trigrams at a time, so that a very long text needs bounded memory.
PIECE = 1 << 20
UNKNOWN = "und"
RESULT = "lang_pred string, score double, proportions map<string,double>, n_grams long"


@functools.cache
def _folded() -> np.ndarray:
    """Code point -> its lower-case code point if it is a letter, else 0."""
    table = np.zeros(0x110000, np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            table[cp] = ord(low) if len(low) == 1 else cp
    return table


def _pieces(text: str) -> Iterator[np.ndarray]:
    """Bucket of each letter's trigram (the letter and its neighbours, 0 beyond a word's ends), piece by piece."""
    for start in range(0, len(text), PIECE):
        lead = 1 if start else 0
        part = text[start - lead : start + PIECE + 1]
        code = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        f = np.zeros(len(code) + 2, np.uint32)
        f[1:-1] = _folded()[code]
        a, b, c = f[:-2], f[1:-1], f[2:]
        last = len(b) if start + PIECE >= len(text) else len(b) - 1
        a, b, c = a[lead:last], b[lead:last], c[lead:last]
        at = b != 0
        h = a[at] * np.uint32(0x9E3779B1) + b[at] * np.uint32(0x85EBCA77) + c[at] * np.uint32(0xC2B2AE3D)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x27D4EB2F)
        yield (h >> np.uint32(32 - BUCKET_BITS)).astype(np.uint16)


def trigram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and how often each occurs."""
    if len(text) > PIECE:
        total = np.zeros(BUCKETS, np.int64)
        for piece in _pieces(text):
            total += np.bincount(piece, minlength=BUCKETS)
        found = np.flatnonzero(total)
        return found, total[found]
    found = next(_pieces(text), np.zeros(0, np.uint16))
    if not len(found):
        return found.astype(np.int64), np.zeros(0, np.int64)
    found.sort(kind="stable")
    starts = np.concatenate([[0], np.flatnonzero(found[1:] != found[:-1]) + 1])
    return found[starts].astype(np.int64), np.diff(np.append(starts, len(found)))


class Profiles:
    """Trigram distributions of the languages, a row of ``likelihood`` for each bucket."""

    def __init__(self, languages: list[str], counts: np.ndarray, smoothing: float = 0.05):
        self.languages = languages
        rates = (counts + smoothing) / (counts.sum(0, keepdims=True) + smoothing * BUCKETS)
        self.log = np.log(rates).astype(np.float32)
        self.likelihood = (rates / rates.max(1, keepdims=True, initial=1e-300)).astype(np.float32)
        self.top = np.log(rates.max(1, initial=1e-300)).astype(np.float32)


def learn(docs: DataFrame, smoothing: float = 0.05) -> Profiles:
    """Count the trigrams of every row of ``docs`` that has text and lang; one row per (language, bucket) comes back.

    What reaches the driver is bounded by languages x buckets, whatever the corpus size.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                total = totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for piece in _pieces(text):
                    total += np.bincount(piece, minlength=BUCKETS) if len(piece) > 4096 else 0
                    if len(piece) <= 4096:
                        np.add.at(total, piece, 1)
        for lang, total in totals.items():
            found = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "bucket": found, "n": total[found]})

    rows = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("lang", "text")
    parts = rows.mapInPandas(count, "lang string, bucket int, n long")
    table = parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(table["lang"].unique())
    counts = np.zeros((BUCKETS, len(languages)))
    column = table["lang"].map({x: i for i, x in enumerate(languages)})
    if len(table):
        counts[table["bucket"].to_numpy(int), column.to_numpy(int)] = table["n"].to_numpy(float)
    return Profiles(languages, counts, smoothing)


def _mix(n: np.ndarray, likelihood: np.ndarray, starts: np.ndarray, sizes: np.ndarray, start_at: np.ndarray, rounds: int):
    """EM for many documents at once: proportions and log-likelihood (less a constant) of each document."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    total = np.add.reduceat(n, starts)[:, None]
    share = start_at
    for _ in range(rounds):
        weighted = likelihood * share[of]
        weighted *= (n / np.maximum(weighted.sum(1), 1e-30))[:, None]
        share = np.add.reduceat(weighted, starts, axis=0) / total
    fit = np.log(np.maximum((likelihood * share[of]).sum(1), 1e-30))
    return share, np.add.reduceat(n * fit, starts)


def infer(profiles: Profiles, grams: list[tuple[np.ndarray, np.ndarray]], rounds: int, penalty: float):
    """Language proportions of documents that all have trigrams; languages outside a document's set have 0.

    Trigrams of one text overlap threefold, so a third of them count as observations.
    """
    sizes = np.array([len(b) for b, _ in grams])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    buckets = np.concatenate([b for b, _ in grams])
    n = np.concatenate([c for _, c in grams]).astype(np.float32)
    seen = np.add.reduceat(n, starts) / 3
    cost = penalty * np.log(np.maximum(seen, 2.0))
    likelihood = profiles.likelihood[buckets]
    k = likelihood.shape[1]
    alone = np.add.reduceat(n[:, None] * np.log(likelihood), starts, axis=0) / 3
    best = alone.argmax(1)
    share = np.zeros((len(grams), k), np.float32)
    share[np.arange(len(grams)), best] = 1
    if k == 1:
        return share
    full, fit = _mix(n, likelihood, starts, sizes, np.full((len(grams), k), 1 / k, np.float32), rounds)
    open_ = np.flatnonzero(fit / 3 - cost > alone.max(1))
    value = alone.max(1)
    order = np.argsort(-full, axis=1, kind="stable")
    for size in range(2, k + 1):
        if not len(open_):
            break
        part = np.concatenate([np.arange(starts[d], starts[d] + sizes[d]) for d in open_])
        begin = np.zeros((len(open_), k), np.float32)
        for i, d in enumerate(open_):
            begin[i, order[d, :size]] = 1 / size
        own = np.concatenate([[0], np.cumsum(sizes[open_])[:-1]])
        mixed, fits = _mix(n[part], likelihood[part], own, sizes[open_], begin, rounds)
        gained = fits / 3 - (size - 1) * cost[open_] > value[open_]
        won = open_[gained]
        share[won] = mixed[gained]
        value[won] = (fits / 3)[gained] - (size - 1) * cost[won]
        open_ = won
    return share


def identify(text: Column, profiles: Profiles, spark, rounds: int = 12, penalty: float = 1.0) -> Column:
    """Column of ``RESULT`` structs for a text column; texts are judged in groups of bounded size."""
    shared = spark.sparkContext.broadcast((profiles.languages, profiles.log, profiles.likelihood, profiles.top))

    @F.pandas_udf(RESULT)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Profiles.__new__(Profiles)
        own.languages, own.log, own.likelihood, own.top = shared.value
        names = np.array(own.languages, object)
        for texts in batches:
            out = [(UNKNOWN, 0.0, {}, 0)] * len(texts)
            held, rows, weight = [], [], 0
            values = texts.tolist()
            for i, text in enumerate(values):
                grams = trigram_counts(text) if text else (np.zeros(0, int),) * 2
                if len(grams[0]) and len(names):
                    held.append(i)
                    rows.append(grams)
                    weight += len(grams[0])
                if rows and (weight > 100_000 or i == len(values) - 1):
                    for j, grams, share in zip(held, rows, infer(own, rows, rounds, penalty)):
                        top = int(share.argmax())
                        kept = {names[x]: float(share[x]) for x in np.flatnonzero(share > 0)}
                        out[j] = (names[top], min(float(share[top]), 1.0), kept, int(grams[1].sum()))
                    held, rows, weight = [], [], 0
            yield pd.DataFrame(out, columns=["lang_pred", "score", "proportions", "n_grams"])

    return judge(text)


def keep_known(docs: DataFrame, profiles: Profiles, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose main language has at least ``least`` of the text, all columns as they were.

    Texts without a letter and texts that no single language dominates go.
    """
    spark = docs.sparkSession
    judged = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), identify(docs["text"], profiles, spark).alias("found"))
    return judged.filter((F.col("found.lang_pred") != UNKNOWN) & (F.col("found.score") >= least)).select("row.*")
