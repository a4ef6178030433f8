"""Whole-text token ids as little-endian bytes, through a bounded cache of words.

Both vocabularies never merge across white space, so a text's ids are those of its pieces in order. A worker keeps
the ids of the pieces it met lately (two generations, so memory stays bounded and old pieces leave), and hands only
unknown pieces to the tokenizers library.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable
from functools import lru_cache

#: Entries of one generation of the cache: about 200 bytes each, in each worker.
CACHE = 600_000
#: Longer pieces are encoded but not kept.
KEEP_CHARS = 48

#: Unicode's White_Space, as the vocabularies' own patterns read \s (fixed values).
WS = "\t-\r \x85\xa0  -     　"
_RUN = re.compile(f"[{WS}] ")
_PIECE = re.compile(f" ?[^{WS}]+|[{WS}]+(?![^{WS}])|[{WS}]+")


_LATIN = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+"
_ASCII_MARKS = r"[!-/:-@\[-`{-~]*"
#: Letters, marks, and perhaps a line break and the same again: both patterns cut there, so words go to the model at once.
_PLAIN = re.compile(f"({_LATIN})({_ASCII_MARKS})(?:\n({_LATIN})({_ASCII_MARKS}))?")
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
#: Byte-level vocabularies write each byte as a letter: shown ones as they are, the others from 256 on.
_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class PieceCache(dict):
    """Ids of pieces under one tokenizer; ``lead`` is put before each piece. Unknown pieces are encoded when asked for."""

    def __init__(self, tokenizer, lead: str, lower: bool, capacity: int = CACHE):
        super().__init__()
        self._tok, self._lead, self._lower, self._capacity = tokenizer, lead, lower, capacity
        self._model, self._old = tokenizer.model, {}
        self._marks: dict[str, bytes] = {"": b""}

    def _library(self, piece: str) -> bytes:
        return _packed(self._tok.encode(piece, add_special_tokens=False).ids)

    def _word(self, word: str, lead: str) -> bytes:
        word = lead + (word.lower() if self._lower else word)
        if word.isascii():
            shown = word.replace(" ", "\u0120")
        else:
            shown = word.encode().decode("latin-1").translate(_LETTERS)
        return _packed([t.id for t in self._model.tokenize(shown)])

    def _mark(self, mark: str) -> bytes:
        if mark not in self._marks:
            if len(self._marks) > 10_000:
                self._marks = {"": b""}
            self._marks[mark] = self._library(mark)
        return self._marks[mark]

    def __missing__(self, piece: str) -> bytes:
        ids = self._old.get(piece)
        if ids is None:
            if m := _PLAIN.fullmatch(piece):
                word, mark, word2, mark2 = m.groups()
                ids = self._word(word, self._lead) + self._mark(mark)
                if word2:
                    ids += self._mark("\n") + self._word(word2, "") + self._mark(mark2)
            else:
                ids = self._library(self._lead + piece)
        if len(piece) <= KEEP_CHARS:
            if len(self) >= self._capacity:
                self._old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Ids:
    """Ids of whole texts under one of the public vocabularies."""

    def __init__(self, path: str, capacity: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True
        self._spaced = "byte" in os.path.basename(path)
        self._first, self._later = PieceCache(tok, "", not self._spaced, capacity), PieceCache(tok, " ", False, capacity)

    def _pieces(self, text: str) -> tuple[list[str], list[str]]:
        """Pieces to encode as they stand, then pieces that follow one space."""
        if not self._spaced:
            return [p for p in text.replace("\n", " ").split(" ") if p], []
        if _RUN.search(text):
            return _PIECE.findall(text), []
        first, *later = text.split(" ")
        return [first] if first else [], later

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        first, later = self._first.__getitem__, self._later.__getitem__
        cut = map(self._pieces, texts)
        return [b"".join(map(first, a)) + b"".join(map(later, b)) for a, b in cut]


@lru_cache(maxsize=4)
def ids_of(path: str, capacity: int = CACHE) -> Ids:
    """One per worker process."""
    return Ids(path, capacity)


def in_blocks(texts: list[str], chars: int = 400_000) -> Iterable[tuple[int, list[str]]]:
    """Runs of texts of about so many characters, with the place of the first."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield at, texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield at, texts[at:]
