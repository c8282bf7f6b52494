"""Exact ids of merge-type SentencePiece models by backtracking, and the way back to text.

The file is read here; the library is not used. Such a model merges neighbouring symbols, best score first and leftmost among
equals. A row of pieces is what that gives exactly if every two neighbours, merged anew from their characters, stay the two they are:
before the first merge across a border, nothing else in the text can have touched the two. So no merging of the whole text is needed:

* an Aho-Corasick automaton gives the longest piece at a position; after it come the shorter pieces it starts with;
* a piece is taken if it stays apart from the piece before it (re-merged once a pair, remembered) and does not end at a position
  known to fail;
* a position where nothing can be taken is marked in a bitfield of failed positions and the piece before it is given up. There is one
  valid row of pieces for every prefix, so a position fails for good and no position is tried more than once for each of its pieces.

A text is first cut where no piece can reach across (before blanks, at line ends, around characters the model lacks). The ids
of short parts are remembered by each worker, up to ``PARTS``; a part without any cut may be as long as the text. Time is linear
in the text, memory is the text's ids, one byte a character of the longest part and the bounded tables.

Defined results: null text counts as empty and gives no ids; characters the model lacks become its byte pieces; repeated rows
and other columns pass through the caller's select; empty tables give no rows. Models that are not of the merge type, rewrite
characters or hold pieces of the user's own are refused with ``ValueError``.
"""

from __future__ import annotations

import codecs
import functools
import itertools
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = "▁"
#: Most parts (twice, see ``before``) and most pairs of pieces that a worker remembers.
PARTS, PAIRS = 200_000, 400_000

# Kinds of pieces and of models in the file format, and what an unknown piece is decoded to.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
MERGE_TYPE = 2
UNKNOWN_TEXT = " ⁇ "


def _number(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (data[at] & 127) << shift
        shift += 7
        at += 1
        if data[at - 1] < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message."""
    at = 0
    while at < len(data):
        key, at = _number(data, at)
        if key & 7 == 0:
            value, at = _number(data, at)
        else:
            size, at = _number(data, at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


codecs.register_error("one mark a byte", lambda e: ("�", e.start + 1))


class Model:
    """The pieces of a model file with their scores and kinds."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            message = list(_fields(file.read()))
        parts = [dict(_fields(v)) for k, v in message if k == 1]
        trainer, rules = ({}, {})
        for k, v in message:
            trainer = dict(_fields(v)) if k == 2 else trainer
            rules = dict(_fields(v)) if k == 3 else rules
        self.pieces = [p[1].decode() for p in parts]
        self.scores = [struct.unpack("<f", p.get(2, bytes(4)))[0] for p in parts]
        self.kinds = [p.get(3, NORMAL) for p in parts]
        if trainer.get(3, 1) != MERGE_TYPE or rules.get(2) or rules.get(4, 1) or not rules.get(5, 1) or set(self.kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError(f"{path} is no plain model of the merge type")
        self.leads = bool(rules.get(3, 1))
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL}
        self.unknown = self.kinds.index(UNKNOWN)
        self.bytes = {int(p[3:-1], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE}

    def merge(self, text: str) -> list[int]:
        """Ids of a short text by merging, character by character."""
        symbols = list(text)
        while True:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                found = self.ids.get(symbols[i] + symbols[i + 1])
                if found is not None and (best is None or self.scores[found] > best):
                    best, at = self.scores[found], i
            if best is None:
                return [self.ids[s] for s in symbols]
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]


class Encoder(Model):
    def __init__(self, path: str):
        import ahocorasick

        super().__init__(path)
        self.single = {p for p in self.ids if len(p) == 1}
        # A piece that its own merging does not give can stand in no result.
        self.automaton = ahocorasick.Automaton()
        self.length = [len(p) for p in self.pieces]
        real = {p: i for p, i in self.ids.items() if self.single.issuperset(p) and self.merge(p) == [i]}
        for piece, i in real.items():
            self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        self.widest = max(map(len, real), default=1)
        #: For each piece the next shorter one that it starts with; -1 after the shortest.
        self.shorter = [-1] * len(self.pieces)
        for piece, i in real.items():
            self.shorter[i] = next((real[piece[:n]] for n in range(len(piece) - 1, 0, -1) if piece[:n] in real), -1)
        together = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.cut = self._borders(together)
        #: Ids of parts met lately, and of those met before that.
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.apart: dict[tuple[int, int], bool] = {}
        self._decoding()

    def stay_apart(self, one: int, two: int) -> bool:
        """Whether two pieces, merged anew from their characters, are these two again."""
        known = self.apart.get((one, two))
        if known is None:
            if len(self.apart) >= PAIRS:
                self.apart.clear()
            known = self.apart[one, two] = self.merge(self.pieces[one] + self.pieces[two]) == [one, two]
        return known

    @staticmethod
    def _borders(together: set[str]) -> re.Pattern:
        """A pattern of parts between which no piece reaches, given all pairs of characters that stand together in a piece."""
        if any(t[1] == BLANK and t[0] != BLANK for t in together):
            return re.compile("(?s).+")
        alone = "\n" if not any("\n" in t for t in together) else ""
        return re.compile(f"{BLANK}*[^{BLANK}{alone}]+|{BLANK}+" + (f"|{alone}" if alone else ""))

    def backtrack(self, text: str) -> list[int]:
        """Ids of a text of known characters."""
        size, widest = len(text), self.widest
        failed, ids = bytearray(size + 1), []
        find, apart, length, shorter = self.automaton.iter_long, self.apart, self.length, self.shorter
        at, last = 0, -1
        while at < size:
            # Every character is a piece, so the first match begins here; nothing longer than the widest piece can.
            piece = next(find(text[at : at + widest]))[1]
            while True:
                end = at + length[piece]
                if not failed[end]:
                    if last < 0:
                        break
                    fits = apart.get((last, piece))
                    if fits or fits is None and self.stay_apart(last, piece):
                        break
                piece = shorter[piece]
                while piece < 0:
                    failed[at] = 1
                    ids.pop()
                    at -= length[last]
                    piece, last = shorter[last], ids[-1] if ids else -1
            ids.append(piece)
            last, at = piece, end
        return ids

    def _part(self, text: str) -> bytes:
        if self.single.issuperset(text):
            return array("i", self.backtrack(text)).tobytes()
        ids, start = [], 0
        for i, c in enumerate(text):
            if c not in self.single:
                ids += self.backtrack(text[start:i])
                ids += [self.bytes[b] for b in c.encode()] if self.bytes else [self.unknown]
                start = i + 1
        return array("i", ids + self.backtrack(text[start:])).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as 32-bit numbers."""
        if not text:
            return b""
        if len(self.known) > PARTS:
            self.before, self.known = self.known, {}
        known, before, out = self.known, self.before, []
        for part in self.cut.findall((BLANK if self.leads else "") + text.replace(" ", BLANK)):
            ids = known.get(part)
            if ids is None:
                ids = before.get(part)
                if ids is None:
                    ids = self._part(part)
                if len(part) < 64:
                    known[part] = ids
            out.append(ids)
        return self._without_repeated_unknown(b"".join(out))

    def _without_repeated_unknown(self, ids: bytes) -> bytes:
        """A model without byte pieces gives one unknown piece for a run of unknown characters."""
        if self.bytes:
            return ids
        numbers = np.frombuffer(ids, "i4")
        again = np.zeros(len(numbers), bool)
        again[1:] = (numbers[1:] == self.unknown) & (numbers[:-1] == self.unknown)
        return numbers[~again].tobytes()

    def _decoding(self) -> None:
        """What each id is written as; bytes from 128 on stand as lone surrogates until the whole text is known."""
        written = {NORMAL: lambda p: p.replace(BLANK, " "), UNKNOWN: lambda p: UNKNOWN_TEXT, CONTROL: lambda p: "", BYTE: lambda p: bytes([int(p[3:-1], 16)]).decode("ascii", "surrogateescape")}
        self.control = {i for i, k in enumerate(self.kinds) if k == CONTROL}
        self.written = [written[k](p) for p, k in zip(self.pieces, self.kinds)]

    def decode(self, ids: list[int]) -> str:
        """The text of any row of ids; bytes that are no UTF-8 become one mark each, control pieces nothing."""
        if self.control.isdisjoint(ids):
            text = self._written(ids)
        else:
            runs = [list(run) for control, run in itertools.groupby(ids, self.control.__contains__) if not control]
            text = "".join(map(self._written, runs))
        first = next((i for i in ids if i not in self.control), None)
        return text[1:] if self.leads and first is not None and self.kinds[first] == NORMAL and text[:1] == " " else text

    def _written(self, ids: list[int]) -> str:
        text = "".join(map(self.written.__getitem__, ids))
        return text if text.isascii() else text.encode("utf-8", "surrogateescape").decode("utf-8", "one mark a byte")


@functools.cache
def encoder(path: str) -> Encoder:
    """The worker's encoder for a model file, kept from task to task."""
    return Encoder(path)


def _lists(rows: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(r) // 4 for r in rows)], dtype="int64").astype("int32")
    values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(rows))])
    return pa.ListArray.from_arrays(pa.array(ends), values)


def encode(text: Column, path: str) -> Column:
    """``text`` as an array of ids."""

    @F.arrow_udf("array<int>")
    def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = encoder(path)
        for batch in batches:
            yield _lists([known.encode(t) for t in batch.to_pylist()])

    return ids_of(F.coalesce(text, F.lit("")))


def decode(ids: Column, path: str) -> Column:
    """Ids as text; null stays null."""

    @F.arrow_udf("string")
    def text_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = encoder(path)
        for batch in batches:
            yield pa.array([None if row is None else known.decode(row) for row in batch.to_pylist()], pa.string())

    return text_of(ids)


def round_trip(text: Column, path: str) -> Column:
    """struct(ids, decoded): the ids of ``text`` and what these are decoded to, both in one pass."""

    @F.arrow_udf("ids array<int>, decoded string")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = encoder(path)
        for batch in batches:
            rows = [known.encode(t) for t in batch.to_pylist()]
            decoded = [known.decode(np.frombuffer(r, "i4").tolist()) for r in rows]
            yield pa.StructArray.from_arrays([_lists(rows), pa.array(decoded, pa.string())], names=["ids", "decoded"])

    return both(F.coalesce(text, F.lit("")))
