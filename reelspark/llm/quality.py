"""Quality scores by a generalised additive model with pairwise interactions.

Features of a text are put into bins. Boosting visits the features in turns; at each visit a shallow tree over the feature's
bins is fitted to the current residuals and a small step of it is added to the feature's lookup table. Then the pairs of
features whose coarse grid explains most of what is left get tables of their own in the same way. A score is the
logistic of an intercept plus one table entry for each feature and pair.

The tables are fitted on a bounded sample of labelled rows (``max_rows``, those with the least hash of doc_id); every
row is scored. Defined results: null text counts as empty and is scored like any other; labels other than 0 and 1 and rows
without doc_id teach nothing; repeated labels of one document count once each value; with no labels every score is 0.5; a
single class gives its smoothed rate; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most labelled rows that the tables are fitted on.
MAX_ROWS = 20_000
BINS, COARSE = 48, 8

FEATURES = (
    "log_bytes log_words word_bytes upper digits punctuation exclamations commas newlines other_signs high_bytes "
    "distinct_words distinct_lines line_bytes longest_word evenness"
).split()

_UPPER, _DIGIT, _SPACE = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT[48:58] = True
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ASCII = np.arange(256)
_PUNCTUATION = np.isin(_ASCII, [33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63])
_OTHER = (_ASCII > 32) & (_ASCII < 127) & ~_PUNCTUATION & ~_DIGIT & ~((_ASCII >= 65) & (_ASCII < 91)) & ~((_ASCII >= 97) & (_ASCII < 123))


def features(text: str | None) -> list[float]:
    data = (text or "").encode("utf-8", "surrogatepass")
    n = max(len(data), 1)
    by = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words, lines = data.split(), data.split(b"\n")
    shares = by[by > 0] / n
    m = max(len(words), 1)
    return [
        np.log1p(len(data)),
        np.log1p(len(words)),
        (n - by[_SPACE].sum()) / m,
        by[_UPPER].sum() / n,
        by[_DIGIT].sum() / n,
        by[_PUNCTUATION].sum() / n,
        by[33] / n,
        by[44] / n,
        by[10] / n,
        by[_OTHER].sum() / n,
        by[128:].sum() / n,
        len(set(words)) / m,
        len(set(lines)) / len(lines),
        n / len(lines),
        np.log1p(max(map(len, words), default=0)),
        float(-(shares * np.log(shares)).sum()) if len(data) else 0.0,
    ]


@dataclass
class Model:
    edges: list[np.ndarray]
    intercept: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        b = self.bins(x)
        z = np.full(len(x), self.intercept)
        for j, table in enumerate(self.tables):
            z += table[b[:, j]]
        for (i, j), table in zip(self.pairs, self.pair_tables):
            z += table[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-z))


def _best_cut(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """Gain and place of the best cut of bins with gradients g and weights h."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    if not len(gain):
        return 0.0, 0
    at = int(gain.argmax())
    return float(gain[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray, ridge: float, leaves: int) -> np.ndarray:
    """Step of each bin: a tree with few leaves, grown where the gain is greatest."""
    spans = [(0, len(g))]
    while len(spans) < leaves:
        cuts = [(*_best_cut(g[s:e], h[s:e], ridge), s, e) for s, e in spans]
        gain, at, s, e = max(cuts)
        if gain <= 1e-9:
            break
        spans.remove((s, e))
        spans += [(s, s + at), (s + at, e)]
    out = np.zeros(len(g))
    for s, e in spans:
        out[s:e] = g[s:e].sum() / (h[s:e].sum() + ridge)
    return out


def _grid_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """A tree of two levels over a grid: the cut of the rows under which the best cuts of the columns on both sides gain most."""
    out = np.zeros_like(g)
    if min(g.shape) < 2:
        return out
    gs, hs = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    gain = np.zeros(len(g) - 1)
    for gp, hp in ((gs[:-1], hs[:-1]), (gs[-1] - gs[:-1], hs[-1] - hs[:-1])):
        left, right = gp[:, :-1], gp[:, -1:] - gp[:, :-1]
        gain += (left**2 / (hp[:, :-1] + ridge) + right**2 / (hp[:, -1:] - hp[:, :-1] + ridge)).max(1)
    at = int(gain.argmax()) + 1
    for rows in (slice(0, at), slice(at, len(g))):
        out[rows] = _tree(g[rows].sum(0), h[rows].sum(0), ridge, 2)
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, step: float = 0.15, n_pairs: int = 6, ridge: float = 1.0) -> Model:
    rate = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
    model = Model([np.zeros(0)] * len(FEATURES), float(np.log(rate / (1 - rate))), [np.zeros(1)] * len(FEATURES))
    if len(np.unique(y)) < 2:
        return model
    model.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    b = model.bins(x)
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    z = np.full(len(y), model.intercept)
    for _ in range(rounds):
        for j, table in enumerate(model.tables):
            p = 1 / (1 + np.exp(-z))
            g = np.bincount(b[:, j], y - p, len(table))
            h = np.bincount(b[:, j], p * (1 - p), len(table))
            add = step * _tree(g, h, ridge, 4)
            table += add
            z += add[b[:, j]]
    model.pairs = _strongest_pairs(b, y - 1 / (1 + np.exp(-z)), [len(t) for t in model.tables], n_pairs)
    shapes = [(len(model.tables[i]), len(model.tables[j])) for i, j in model.pairs]
    model.pair_tables = [np.zeros(s) for s in shapes]
    for turn in range(rounds // 2):
        for (i, j), table in zip(model.pairs, model.pair_tables):
            p = 1 / (1 + np.exp(-z))
            cell = b[:, i] * table.shape[1] + b[:, j]
            g = np.bincount(cell, y - p, table.size).reshape(table.shape)
            h = np.bincount(cell, p * (1 - p), table.size).reshape(table.shape)
            add = step * (_grid_tree(g, h, ridge) if turn % 2 else _grid_tree(g.T, h.T, ridge).T)
            table += add
            z += add[b[:, i], b[:, j]]
    return model


def _strongest_pairs(b: np.ndarray, left: np.ndarray, sizes: list[int], n: int) -> list[tuple[int, int]]:
    """The pairs whose coarse grid explains most of the residuals beyond what its rows and columns do."""
    coarse = np.stack([b[:, j] * COARSE // sizes[j] for j in range(b.shape[1])], axis=1)
    gains = []
    for i in range(b.shape[1]):
        for j in range(i + 1, b.shape[1]):
            cell = coarse[:, i] * COARSE + coarse[:, j]
            total, count = np.bincount(cell, left, COARSE**2), np.bincount(cell, minlength=COARSE**2)
            t, c = total.reshape(COARSE, COARSE), count.reshape(COARSE, COARSE)
            alone = sum((t.sum(a) ** 2 / (c.sum(a) + 1)).sum() for a in (0, 1))
            gains.append(((total**2 / (count + 1)).sum() - alone, i, j))
    return [(i, j) for _, i, j in sorted(gains, reverse=True)[:n]]


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, **how) -> Model:
    """Fit on ``docs`` (doc_id, text) joined to ``labels`` (doc_id, quality); a bounded sample reaches the driver, as features."""
    marks = labels.filter("quality in (0, 1) and doc_id is not null").select("doc_id", "quality").distinct()
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_rows)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array([features(t) for t in batch["text"]], float).reshape(-1, len(FEATURES))
            yield pd.DataFrame(x, columns=FEATURES).assign(quality=batch["quality"].to_numpy(int))

    shape = ", ".join(f"{f} double" for f in FEATURES) + ", quality int"
    # max_rows bounds the side that travels; of rows that repeat a doc_id one text counts, so no more rows than marks come back.
    met = docs.select(docs["doc_id"], docs["text"]).join(F.broadcast(chosen), "doc_id")
    one = met.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    sample = one.select("text", "quality").mapInPandas(rows, shape).orderBy(*FEATURES, "quality").toPandas()
    return fit(sample[FEATURES].to_numpy(float), sample["quality"].to_numpy(float), **how)


def score(text: Column, model: Model, spark) -> Column:
    """Column of scores between 0 and 1 for a text column."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([features(t) for t in texts], float).reshape(-1, len(FEATURES))
            yield pd.Series(shared.value.score(x))

    return scores(text)
