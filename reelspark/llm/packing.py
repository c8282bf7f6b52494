"""Packing examples into training sequences: vector bin packing by the dot-product heuristic.

A sequence has three limits at once: tokens, segments and loss-bearing tokens. An open sequence takes, of a pool of waiting
pieces that fit, the one whose share of the limits has the greatest dot product with what is left of them; if none fits, the
one with the greatest product is cut to fill what is left. Whole sequences are cut off long examples at once. A sequence that
cannot be filled (its segments or loss are used up, or nothing waits) is cut back to a power of two, which needs no
padding; what it gives back waits on.

Each task packs the rows it reads, so ids never leave the task that made them and nothing is gathered; a task leaves at most
a dozen short sequences. Memory is bounded by the pool and one batch of rows.

Defined results: null text counts as empty (only the end id remains); null and repeated doc_ids are packed like any row, ids of any
size stay as they are; texts of any length are cut into pieces; empty tables give no rows. ``sequence_id`` is the task's number in the high bits, so ids repeat if the input is split alike.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from reelspark.llm.tokenizing import groups, pieces

#: Waiting pieces to choose from.
POOL = 256


@dataclass(frozen=True)
class Limits:
    tokens: int = 4096
    segments: int = 256
    loss: int = 4096

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.segments, self.loss], float)


class Example:
    """Ids of an example as bytes; the first ``prompt`` of them bear no loss."""

    __slots__ = ("ids", "key", "n", "prompt")

    def __init__(self, key, ids: bytes, prompt: int):
        self.key, self.ids, self.n, self.prompt = key, ids, len(ids) // 4, prompt


class Packer:
    def __init__(self, limits: Limits):
        self.limits, self.scale = limits, limits.vector()
        #: Waiting pieces: example, start, end; their sizes are kept beside them for the choice.
        self.waiting: list[tuple[Example, int, int]] = []
        self.sizes = np.zeros((0, 3))
        self.sequence = 0

    @staticmethod
    def _loss(x: Example, start: int, end: int) -> int:
        return max(0, end - max(start, x.prompt))

    def _longest(self, x: Example, start: int, end: int, tokens: float, loss: float) -> int:
        """The furthest end a piece from ``start`` may have."""
        end = min(end, start + int(tokens))
        return min(end, max(start, x.prompt) + int(loss))

    def _emit(self, parts: list[tuple[Example, int, int]]) -> Iterator[tuple]:
        offset = 0
        for x, start, end in parts:
            yield x, start, end - start, self.sequence, offset
            offset += end - start
        self.sequence += 1

    def add(self, examples: list[Example]) -> Iterator[tuple]:
        """Pieces of the sequences that become full."""
        new = []
        for x in examples:
            start, whole = 0, self._longest(x, 0, x.n, self.limits.tokens, self.limits.loss)
            while whole - start == self.limits.tokens:
                yield from self._emit([(x, start, whole)])
                start, whole = whole, self._longest(x, whole, x.n, self.limits.tokens, self.limits.loss)
            if start < x.n:
                new.append((x, start, x.n))
        self._wait(new)
        while len(self.waiting) >= POOL:
            yield from self._emit(self._fill())

    def end(self) -> Iterator[tuple]:
        while self.waiting:
            yield from self._emit(self._fill())

    def _wait(self, new: list[tuple[Example, int, int]]) -> None:
        if new:
            self.waiting += new
            self.sizes = np.concatenate([self.sizes, np.array([(e - s, 1, self._loss(x, s, e)) for x, s, e in new], float)])

    def _take(self, i: int) -> tuple[Example, int, int]:
        """Remove a waiting piece; the last one moves to its place."""
        x = self.waiting[i]
        self.waiting[i] = self.waiting[-1]
        self.waiting.pop()
        self.sizes[i] = self.sizes[-1]
        self.sizes = self.sizes[:-1]
        return x

    def _fill(self) -> list[tuple[Example, int, int]]:
        left, parts = self.scale.copy(), []
        while self.waiting and (left[:2] >= 1).all():
            worth = self.sizes @ (left / self.scale**2)
            fits = (self.sizes <= left).all(1)
            i = int(np.where(fits, worth, -1).argmax()) if fits.any() else int(worth.argmax())
            x, start, end = self._take(i)
            upto = end if fits.any() else self._longest(x, start, end, left[0], left[2])
            if upto > start:
                parts.append((x, start, upto))
                left -= (upto - start, 1, self._loss(x, start, upto))
            if upto < end:
                self._wait([(x, upto, end)])
                if upto == start:
                    break
        total = sum(e - s for _, s, e in parts)
        if total < self.limits.tokens:
            self._give_back(parts, total - (1 << (total.bit_length() - 1)))
        return parts

    def _give_back(self, parts: list[tuple[Example, int, int]], surplus: int) -> None:
        while surplus:
            x, start, end = parts.pop()
            keep = max(0, end - start - surplus)
            surplus -= end - start - keep
            self._wait([(x, start + keep, end)])
            if keep:
                parts.append((x, start, start + keep))


def pack(docs: DataFrame, path: str, end_id: int, limits: Limits = Limits(), prompt: str | None = None, with_ids: bool = False, forget: bool = False) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, loss_tokens, sequence_id, offset) of the rows of ``docs``.

    ``prompt`` names a text column that goes before ``text`` and bears no loss. ``with_ids`` adds the piece's ids as
    little-endian unsigned 32-bit numbers. ``forget`` empties a worker's memory of token pieces after each task, for jobs that go on with
    other work in the same workers.
    """
    end = np.array([end_id], "<u4").tobytes()
    kind = docs.schema["doc_id"].dataType
    long = T.LongType()
    # The id goes through pandas as text: beside a null, whole numbers would become doubles there.
    fields = [T.StructField("doc_id", T.StringType()), *(T.StructField(c, long) for c in ("start", "length", "ids_crc32", "doc_tokens", "loss_tokens", "sequence_id", "offset"))]
    if with_ids:
        fields.append(T.StructField("ids", T.BinaryType()))
    names = [f.name for f in fields]

    def frame(rows: list[tuple], base: int) -> pd.DataFrame:
        out = []
        for x, start, n, sequence, offset in rows:
            ids = x.ids[4 * start : 4 * (start + n)]
            row = (x.key, start, n, zlib.crc32(ids), x.n, Packer._loss(x, start, start + n), base + sequence, offset)
            out.append((*row, ids) if with_ids else row)
        data = pd.DataFrame(out, columns=names)
        data["doc_id"] = pd.Series([r[0] for r in out], dtype=object)
        return data

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, packer = pieces(path, False), Packer(limits)
        base = TaskContext.get().partitionId() << 36
        for batch in batches:
            keys = iter(batch["doc_id"].tolist())
            heads = iter(batch["prompt"].tolist() if prompt else ())
            for texts in groups([t or "" for t in batch["text"]]):
                found = encoder.encode(texts)
                before = encoder.encode([next(heads) or "" for _ in texts]) if prompt else [b""] * len(texts)
                examples = [Example(next(keys), b + ids + end, len(b) // 4) for b, ids in zip(before, found)]
                rows = list(packer.add(examples))
                if rows:
                    yield frame(rows, base)
        rows = list(packer.end())
        if forget:
            encoder.forget()
        if rows:
            yield frame(rows, base)

    columns = [docs["doc_id"].cast("string").alias("doc_id"), docs["text"], *([docs[prompt].alias("prompt")] if prompt else [])]
    packed = docs.select(*columns).mapInPandas(run, T.StructType(fields))
    return packed.select(packed["doc_id"].cast(kind).alias("doc_id"), *names[1:])
