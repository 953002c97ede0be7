"""Texts cut where no pre-token of the byte-level pattern can cross, and encoded by cache."""

from __future__ import annotations

import re
import string
from collections.abc import Callable
from itertools import islice

_ADJACENT_SPACES = re.compile(r"\s\s")
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def cut(text: str) -> list[str]:
    """Pieces that give ``text`` when joined by spaces, each of which begins what follows it.

    A pre-token holds a space only as its first character or in a run of white space, so a
    lone space always begins one: encoding the first piece and then every other one behind
    a space gives the whole's ids.
    """
    return text.split(" ") if _ADJACENT_SPACES.search(text) is None else _LONE_SPACE.split(text)


#: Longer pieces, such as encoded blobs and minified code, hardly come twice and are not kept.
LONGEST = 200


class _Encoded(dict):
    """Pieces to their encodings, behind ``lead``; a new one is encoded when it is asked for, and kept
    if it is no longer than ``LONGEST``. All start anew at ``limit`` entries or, in sum, sixteen
    times as many characters, also within a text.

    A piece that ends in punctuation after a letter or digit is put together from its two
    parts, between which there always is a bound of pre-tokens.
    """

    def __init__(self, lead: str, encode: Callable[[str], object], join: Callable[[object, object], object], limit: int) -> None:
        self.lead, self.encode, self.join, self.tails, self.limit, self.held = lead, encode, join, self, limit, 0

    def __missing__(self, piece: str) -> object:
        stem = piece.rstrip(string.punctuation)
        if stem and stem != piece and stem[-1].isalnum():
            value = self.join(self[stem], self.tails[piece[len(stem) :]])
        else:
            value = self.encode(self.lead + piece)
        if len(piece) <= LONGEST:
            if len(self) >= self.limit or self.held >= 16 * self.limit:
                self.clear()
                self.held = 0
            self[piece] = value
            self.held += len(piece)
        return value


class PieceCache:
    """Encodings of the pieces of a text, in bounded memory: of both groups of pieces, those
    behind a space and others, at most ``limit`` are kept. ``join`` gives the encoding of
    two pieces in a row."""

    def __init__(self, encode: Callable[[str], object], join: Callable[[object, object], object], limit: int = 600_000) -> None:
        self.plain, self.spaced = _Encoded("", encode, join, limit), _Encoded(" ", encode, join, limit)
        self.spaced.tails = self.plain

    def __call__(self, text: str) -> list:
        pieces = cut(text)
        out = [self.plain[pieces[0]]] if pieces[0] else []
        out += map(self.spaced.__getitem__, islice(pieces, 1, None))
        return out
