"""Words and terms of whole texts as UTF-8 bytes, piece by piece, so that a very long text needs no list of all its words."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Bytes of a piece; a word that crosses the end of a piece belongs to it whole.
PIECE = 1 << 20

_BLANK = re.compile(rb"[\x20\x09-\x0d]")
_LETTERS = bytes(range(ord("a"), ord("z") + 1))
_DIGITS = b"0123456789"


def _table(kept: bytes) -> bytes:
    """A translation that lower-cases A-Z, keeps ``kept`` and all bytes above 127, and turns the rest into blanks."""
    return bytes(c if c > 127 or c in kept else 32 for c in bytes(range(256)).lower())


#: Terms are runs of letters, or of letters and digits; every character beyond ASCII counts as a letter.
LETTER_TERMS, ALPHANUMERIC_TERMS = _table(_LETTERS), _table(_LETTERS + _DIGITS)


def pieces(data: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """The runs without bytes 9-13 and 32, in order, as a list for each piece of the text."""
    at = 0
    while at < len(data):
        blank = _BLANK.search(data, at + size)
        end = blank.start() if blank else len(data)
        yield (data[at:end] if at or end < len(data) else data).split()
        at = end
