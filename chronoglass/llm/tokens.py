"""Token ids of whole texts by a public tokenizer, unit by unit."""

from __future__ import annotations

import os
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from .common import kept_by_worker

END = 2
#: Units, and pieces of them, that a Python worker keeps of the two newest generations; the longest unit it keeps.
STORE, LONGEST = 250_000, 48
#: What Python takes for white space and the tokenizers' patterns don't.
_ODD = re.compile("[\x1c-\x1f]").search
#: Latin text, where letters and numbers are the same in every version of Unicode; other units go through the library.
_LATIN = "\u0250"


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(ord(_LATIN)) if unicodedata.category(chr(c))[0] == kind)


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: bytes that print stand for themselves, the others for the letters from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in shown)
    return {b: chr(256 + k) for k, b in enumerate(rest)}


def _mark(token: str) -> str:
    """What a text must hold as it is to hold a special token in any case: its longest part that is not letters or digits."""
    return max(re.findall(r"[^\w\s]+", token), key=len, default="")


class Kept(dict):
    """A store of what make(key) gives, in two generations: what the older one holds is kept on when it is asked for."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def turn(self) -> None:
        if len(self) > self.size:
            self.old = dict(self)
            self.clear()

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= LONGEST:
            self[key] = found
        return found


class Encoder:
    """Encodes texts exactly as the tokenizers library does, without encoding a unit that it has seen before again.

    A unit is text between two spaces. Both tokenizer kinds cut texts at spaces before any merge, so a text's ids are
    its units' ids in order: for the byte-level one a unit takes the space before it along, and texts with two spaces in
    a row go through the library whole; for the one that drops white space, a unit is a word. A new unit of Latin text is
    cut into the tokenizer's own pieces, and new pieces go to the library's merge model; any other new unit goes through
    the library as it is. The library finds its special tokens anywhere in a text, so a text that may hold one goes
    through it whole.
    """

    def __init__(self, path: str, size: int = STORE):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok = Tokenizer.from_file(path)
        self.marks = {_mark(t.content) for t in self.tok.get_added_tokens_decoder().values()}
        self.spaced = self.tok.encode("a b", add_special_tokens=False).ids != self.tok.encode("a  b", add_special_tokens=False).ids
        letter, number, ends = _class("L"), _class("N"), "'s|'t|'re|'ve|'m|'ll|'d"
        pattern = rf"{ends}| ?[{letter}]+| ?[{number}]+| ?[^\s{letter}{number}]+|\s+(?!\S)|\s+" if self.spaced else rf"{ends}|[{letter}]+|[{number}]|[^\s{letter}{number}]+"
        self.cut, self.letters = re.compile(pattern).findall, _byte_letters()
        self.units, self.pieces = Kept(self._unit, size), Kept(self._piece, size)

    def plain(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _unit(self, unit: str) -> bytes:
        text = f" {unit}" if self.spaced else unit
        if not unit or max(unit) >= _LATIN:
            return self.plain(text)
        if not self.spaced:
            text = unit.lower() if unit.isascii() else self.tok.normalizer.normalize_str(unit)
            if max(text) >= _LATIN:
                return self.plain(unit)
        return b"".join(map(self.pieces.__getitem__, self.cut(text)))

    def _piece(self, piece: str) -> bytes:
        ids = [t.id for t in self.tok.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text, without an end id. Null texts are empty."""
        self.units.turn()
        self.pieces.turn()
        get = self.units.__getitem__
        for t in texts:
            t = t or ""
            if _ODD(t) or (self.spaced and "  " in t) or any(m in t for m in self.marks):
                yield self.plain(t)
            elif self.spaced:
                first, *rest = t.split(" ")
                yield (self.plain(first) if first else b"") + b"".join(map(get, rest))
            else:
                yield b"".join(map(get, (t if t.isascii() else unicodedata.normalize("NFC", t)).split()))


@kept_by_worker
@lru_cache(maxsize=4)
def encoder(path: str, size: int = STORE) -> Encoder:
    """One per Python worker and file, so that its store outlives a task, until a task of another operator comes."""
    return Encoder(path, size)


def public(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
