"""Exact token ids of a public tokenizer file, encoding each distinct piece of text once per worker.

The tokenizer library splits a text into pieces before it merges inside them, so a text's ids are its pieces' ids in order.
A plain text of the layout that drops white space (Latin letters, digits, ASCII signs) is cut by that layout's pattern at once.
Other texts are cut at single spaces between non-spaces, which both supported layouts always cut at; a plain chunk is cut further
by the layout's own pattern. Everything else - other scripts, special strings, odd
white space, tokenizers of another layout - goes to the library uncut. The memory of pieces is bounded; when it is full, what the
texts at hand do not use is dropped, so that common words are not learned again and again.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import json
import os
import re
from struct import pack

import numpy as np

#: About the most chunks and the most pieces that a worker remembers.
CHUNKS, PIECES = 150_000, 200_000
#: Latin letters that have a one-character lower case and no decomposition across pieces, with ASCII signs and digits.
_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ſ"
_PLAIN = re.compile("[!-~À-ÖØ-öø-įı-ſ]+")
_PLAIN_TEXT = re.compile("[!-~À-ÖØ-öø-įı-ſ \t\n\r]*")
_PLAIN_SPACED = re.compile(f" ?{_PLAIN.pattern}")
_CONTRACTED = "'s|'t|'re|'ve|'m|'ll|'d"
_SPACED = re.compile(f"{_CONTRACTED}| ?[{_LETTERS}]+| ?[0-9]+| ?[^\\s{_LETTERS}0-9]+")
_BARE = re.compile(f"{_CONTRACTED}|[{_LETTERS}]+|[0-9]|[^\\s{_LETTERS}0-9]+")
_SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: A character that the library, unlike Python, may take for white space.
_DOUBTFUL = "᠎"


def _shown() -> dict[int, str]:
    """The character that byte-level tokenizers show for each byte, by code point of plain text."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = iter(range(256, 512))
    byte = [chr(b) if b in kept else chr(next(moved)) for b in range(256)]
    return {cp: "".join(byte[b] for b in chr(cp).encode()) for cp in range(32, 0x180)}


_SHOWN = _shown()


class Pieces:
    """Ids of texts as bytes of little-endian unsigned 32-bit numbers, or (``counting``) their number."""

    def __init__(self, path: str, counting: bool):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.counting = counting
        layout = json.loads(self.library.to_str())
        split = json.dumps(layout["pre_tokenizer"])
        plain = layout["post_processor"] is None and not layout["model"].get("dropout")
        self.spaced = plain and layout["normalizer"] is None and '"ByteLevel"' in split and '"add_prefix_space": false' in split and '"use_regex": true' in split and '"Split"' not in split
        self.bare = plain and "[\\\\p{L}]+|[\\\\p{N}]|[^\\\\s\\\\p{L}\\\\p{N}]+" in split and '"Lowercase"' in json.dumps(layout["normalizer"])
        self.special = [t["content"] for t in layout["added_tokens"]]
        #: What every special string starts with.
        self.mark = os.path.commonprefix(self.special)
        if self.special and not self.mark:
            self.spaced = self.bare = False
        self.chunks: dict[str, object] = {}
        self.pieces: dict[str, object] = {}

    def _value(self, ids: list[int]):
        return len(ids) if self.counting else np.array(ids, "<u4").tobytes()

    def _whole(self, texts: list[str]) -> list:
        return [self._value(e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_pieces(self, new: set[str]) -> None:
        """Merge inside pieces: a piece is a unit of the library's own split, so its model takes it as it is."""
        tokenize, remembered = self.library.model.tokenize, self.pieces
        for piece in new:
            ids = [t.id for t in tokenize(piece.translate(_SHOWN))]
            remembered[piece] = len(ids) if self.counting else pack(f"<{len(ids)}I", *ids)

    def _recall(self, used: set[str]) -> None:
        """See to it that all pieces in use are remembered."""
        if len(self.pieces) > PIECES:
            self.pieces = {p: v for p, v in self.pieces.items() if p in used}
        self._learn_pieces(used.difference(self.pieces))

    def _learn(self, chunks: set[str]) -> None:
        """Remember the values of chunks as they stand in a text (with their leading space in the spaced layout)."""
        cut, whole = [], []
        pattern, plain = (_SPACED, _PLAIN_SPACED) if self.spaced else (_BARE, _PLAIN)
        for chunk in chunks:
            if plain.fullmatch(chunk) and not (self.special and self.mark in chunk):
                cut.append((chunk, pattern.findall(chunk if self.spaced else chunk.lower())))
            else:
                whole.append(chunk)
        self._recall({p for _, ps in cut for p in ps})
        get = self.pieces.__getitem__
        if self.counting:
            self.chunks.update((chunk, sum(map(get, ps))) for chunk, ps in cut)
        else:
            self.chunks.update((chunk, get(ps[0]) if len(ps) == 1 else b"".join(map(get, ps))) for chunk, ps in cut)
        self.chunks.update(zip(whole, self._whole(whole)))

    def _cut(self, text: str) -> list[str] | None:
        """Chunks whose values add up to the text's, or None if the text must go to the library whole."""
        if not (self.spaced or self.bare) or _DOUBTFUL in text or any(" " in s for s in self.special):
            return None
        if self.bare:
            return text.split(" ")
        # A space next to other white space is no border here.
        parts = text.split(" ") if not re.search(r"\s | \s|^ | $", text) else _SINGLE_SPACE.split(text)
        return [parts[0], *[" " + p for p in parts[1:]]]

    def _parts(self, text: str) -> list[str] | None:
        """The pieces of a plain text in the layout without white space, else None."""
        if self.bare and _PLAIN_TEXT.fullmatch(text) and not (self.special and self.mark in text):
            return _BARE.findall(text.lower())
        return None

    def _by_chunks(self, texts: list[str]) -> list:
        cuts = [self._cut(t) for t in texts]
        used = set().union(*filter(None, cuts))
        if len(self.chunks) > CHUNKS:
            self.chunks = {c: v for c, v in self.chunks.items() if c in used}
        new = used.difference(self.chunks)
        if new:
            self._learn(new)
        return [self._whole([t])[0] if cut is None else self._joined(self.chunks, cut) for t, cut in zip(texts, cuts)]

    def _joined(self, values: dict, parts: list[str]):
        found = map(values.__getitem__, parts)
        return sum(found) if self.counting else b"".join(found)

    def forget(self) -> None:
        """Give back the memory of chunks and pieces; the next text learns them anew."""
        self.chunks, self.pieces = {}, {}
        gc.collect()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library than the GNU one: it keeps what was freed
            pass

    def encode(self, texts: list[str]) -> list:
        parts = [self._parts(t) for t in texts]
        others = iter(self._by_chunks([t for t, p in zip(texts, parts) if p is None]))
        self._recall(set().union(*filter(None, parts)))
        return [next(others) if p is None else self._joined(self.pieces, p) for p in parts]


@functools.cache
def pieces(path: str, counting: bool) -> Pieces:
    """The worker's encoder for a tokenizer file, kept from task to task."""
    return Pieces(path, counting)


def groups(texts: list[str], chars: int = 1 << 20):
    """Slices of ``texts`` of about ``chars`` characters."""
    start, weight = 0, 0
    for i, text in enumerate(texts):
        weight += len(text)
        if weight >= chars:
            yield texts[start : i + 1]
            start, weight = i + 1, 0
    if start < len(texts):
        yield texts[start:]
