"""Terms of whole texts on UTF-8 bytes: maximal runs of letters (or letters and digits), A-Z lower-cased.

Every character beyond ASCII belongs to a term, so a term never ends inside a character and one table of 256 entries folds
and cuts a text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import xxhash


def fold(digits: bool = False) -> bytes:
    """The table for ``bytes.translate``: bytes of terms stay, A-Z become a-z, all others a space."""
    out = bytearray(b" " * 128 + bytes(range(128, 256)))
    for c in b"abcdefghijklmnopqrstuvwxyz":
        out[c] = out[c - 32] = c
    if digits:
        out[48:58] = b"0123456789"
    return bytes(out)


LETTERS, WORDS = fold(), fold(True)


def term_lists(text: bytes, table: bytes, piece: int = 1 << 20) -> Iterator[list[bytes]]:
    """The terms of ``text`` in order, as lists of about ``piece`` bytes of text."""
    flat = text.translate(table)
    at, end = 0, len(flat)
    while at < end:
        to = flat.find(b" ", at + piece)
        to = end if to < 0 else to
        yield flat[at:to].split()
        at = to


def term_counts(text: bytes | None, table: bytes) -> Counter:
    """Occurrences of each term; null has none."""
    found: Counter = Counter()
    for some in term_lists(text or b"", table):
        found.update(some)
    return found


def digests(keys: list[bytes]) -> bytes:
    """16 bytes a key, the same in every process."""
    digest = xxhash.xxh3_128_digest
    return b"".join(map(digest, keys))
