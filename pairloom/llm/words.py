"""Words of UTF-8 texts by whole-buffer byte operations, for tasks that count them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Bytes of a text that are split at a time; a slice ends at a space or mark, so no word is cut.
SLICE = 1 << 20
#: Stands for a stop; UTF-8 has no such byte.
MARK = b"\xff"


def byte_table(word: str, blank: str, stop: str = "") -> bytes:
    """A table for bytes.translate: A-Z lower-cased, blank to a space, stop to MARK.

    word, blank and stop say in turn which of the 128 ASCII bytes are what; bytes from 128 on are parts of words.
    """
    table = bytearray(range(256))
    for c in blank:
        table[ord(c)] = 0x20
    for c in stop:
        table[ord(c)] = MARK[0]
    for c in word:
        table[ord(c)] = ord(c.lower())
    return bytes(table)


class Numbers(dict):
    """Numbers for keys, in the order of their first look-up, from the number of keys that it starts with."""

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        return n


def slices(text: bytes, size: int = SLICE) -> Iterator[bytes]:
    """text in parts of about size bytes, each of which ends behind a space or MARK (or at the end)."""
    at, end = 0, len(text)
    while end - at > size:
        cut = max(text.rfind(b" ", at, at + size), text.rfind(MARK, at, at + size))
        if cut < 0:  # one word over a whole slice
            after = [i for i in (text.find(b" ", at + size), text.find(MARK, at + size)) if i >= 0]
            if not after:
                break
            cut = min(after)
        yield text[at : cut + 1]
        at = cut + 1
    if at < end:
        yield text[at:]


def utf8(values: pa.Array) -> pa.Array:
    return values.cast(pa.string(), safe=False)
