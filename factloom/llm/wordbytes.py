"""Words of whole texts as bytes, cut by a translation table: bytes that belong to no word become spaces."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

#: Bytes split at once; longer texts are cut between words, so that memory follows a text's distinct words.
SEGMENT = 1 << 20


def separating(keep: bytes) -> bytes:
    """A table that keeps the bytes of ``keep``, lower-cases A-Z and turns all others into spaces."""
    table = bytearray(b" " * 256)
    for b in keep:
        table[b] = b
    for b in range(0x41, 0x5B):
        if b in keep:
            table[b] = b + 32
    return bytes(table)


_ALNUM = bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)])
#: UTF-8: digits, letters of ASCII and all bytes of other characters.
TERMS = separating(_ALNUM + bytes(range(0x80, 0x100)))
#: Latin-1, a byte for each code point: letters of ASCII and U+00C0 to U+00FF. Other characters are replaced by ``?`` before.
LETTERS = separating(_ALNUM[10:] + bytes(range(0xC0, 0x100)))


def split(raw: bytes, table: bytes) -> Iterator[list[bytes]]:
    """The words of ``raw`` in order, a list for each segment."""
    if len(raw) <= SEGMENT:
        yield raw.translate(table).split()
        return
    at, clean = 0, raw.translate(table)
    while at < len(clean):
        to = len(clean) if at + SEGMENT >= len(clean) else clean.find(b" ", at + SEGMENT)
        to = len(clean) if to < 0 else to
        yield clean[at:to].split()
        at = to


def counted(raw: bytes, table: bytes) -> Counter:
    found: Counter = Counter()
    for words in split(raw, table):
        found.update(words)
    return found
