"""Polynomial hashes modulo 2^64 of substrings, from one array of prefix sums, and the words of a text by them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

STEP, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
#: Bytes of a text that are hashed at a time, cut at white space.
TEXT_BLOCK = 1 << 18
# What a byte counts as (A-Z lower-cased, and no byte as nothing), and whether it ends a word: [\x20\x09-\x0D].
BYTE = np.arange(1, 257, dtype=np.uint64)
BYTE[65:91] += np.uint64(32)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX
    return h ^ (h >> np.uint64(29))


@lru_cache(maxsize=2)
def _powers(n: int, inverse: bool) -> np.ndarray:
    """0 to n times the step's power, or its inverse's, modulo 2^64."""
    step = pow(int(STEP), -1, 1 << 64) if inverse else int(STEP)
    out = np.full(n + 1, step, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def prefixes(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(prefix, inverse): (prefix[at + size] - prefix[at]) * inverse[at] is the hash of a substring."""
    n = len(symbols)
    room = max(TEXT_BLOCK, 1 << n.bit_length())
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(symbols * _powers(room, False)[:n], out=prefix[1:])
    return prefix, _powers(room, True)


def _blocks(raw: np.ndarray) -> Iterator[np.ndarray]:
    at = 0
    while at < len(raw):
        end = at + TEXT_BLOCK
        while end < len(raw):  # not inside a word
            spaces = np.flatnonzero(SPACE[raw[at:end]])
            if len(spaces):
                end = at + int(spaces[-1]) + 1
                break
            end += TEXT_BLOCK
        yield raw[at:end]
        at = end


def word_hashes(text: str) -> np.ndarray:
    r"""64-bit hashes of the words [^\x20\x09-\x0D]+ of a text, A-Z lower-cased, in order."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    out = []
    for block in _blocks(raw):
        edges = np.flatnonzero(np.diff(SPACE[block], prepend=True, append=True))
        start, end = edges[::2], edges[1::2]
        prefix, inverse = prefixes(BYTE[block])
        out.append(mixed((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64)))
    return out[0] if len(out) == 1 else np.concatenate(out) if out else np.empty(0, np.uint64)
