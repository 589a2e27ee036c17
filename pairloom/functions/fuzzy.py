"""Sequence-matcher and fuzzy ratios: sequential algorithms, in Arrow batches."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

NOT_WORD = re.compile(r"[\W_]")


#: From this length of the second text on, SequenceMatcher leaves out frequent characters.
POPULAR = 200


def matching_blocks(a: str, b: str) -> list[tuple[int, int, int]]:
    """(start in a, start in b, length) of SequenceMatcher's blocks, in no order.

    The longest match of two ranges (the first in a, then in b) is grown by searches for the next longer piece.
    """
    if len(b) >= POPULAR:
        return [tuple(m) for m in SequenceMatcher(None, a, b).get_matching_blocks() if m.size]
    out, open_ranges = [], [(0, len(a), 0, len(b))]
    while open_ranges:
        left, right, low, high = open_ranges.pop()
        size, at, i = 0, left, left
        while i + size < right:
            if b.find(a[i : i + size + 1], low, high) >= 0:
                size, at = size + 1, i
            else:
                i += 1
        if size:
            to = b.find(a[at : at + size], low, high)
            out.append((at, to, size))
            if left < at and low < to:
                open_ranges.append((left, at, low, to))
            if at + size < right and to + size < high:
                open_ranges.append((at + size, right, to + size, high))
    return out


def sequence_ratio(a: str, b: str) -> float:
    """Twice the matched characters over all characters, by longest matching blocks."""
    if a == b:
        return 1.0
    return 2.0 * sum(size for _, _, size in matching_blocks(a, b)) / (len(a) + len(b))


def processed(text: str) -> str:
    """Other characters than letters and digits become spaces; lower case; trimmed."""
    return NOT_WORD.sub(" ", text).lower().strip()


class Ratios:
    """The ratios of one pair of texts; what several of them need is found once."""

    def __init__(self, a: str, b: str):
        self.a, self.b = a, b
        self.x, self.y = processed(a), processed(b)
        self.known: dict[tuple[bool, str, str], int] = {}

    def plain(self, a: str, b: str) -> int:
        key = (False, a, b)
        if key not in self.known:
            self.known[key] = 100 if a == b else round(100 * sequence_ratio(a, b))
        return self.known[key]

    def partial(self, a: str, b: str) -> int:
        """Best ratio of the shorter text with windows of its length that the matching blocks suggest."""
        key = (True, a, b)
        if key not in self.known:
            self.known[key] = self._partial(*((a, b) if len(a) <= len(b) else (b, a)))
        return self.known[key]

    def _partial(self, short: str, long: str) -> int:
        if not short:
            return 0 if long else 100
        if len(long) < POPULAR and short in long:
            return 100
        starts = {max(0, to - at) for at, to, _ in matching_blocks(short, long)} | {len(long) - len(short)}
        letters = {c: short.count(c) for c in set(short)}
        windows = {long[start : start + len(short)] for start in starts}
        # the letters that both have bound a ratio from above
        bounded = sorted(((2.0 * sum(min(n, w.count(c)) for c, n in letters.items()) / (len(short) + len(w)), w) for w in windows), reverse=True)
        best = 0.0
        for most, window in bounded:
            if most <= best:
                break
            best = max(best, sequence_ratio(short, window))
            if best > 0.995:
                return 100
        return round(100 * best)

    def qratio(self) -> int:
        return self.plain(self.x, self.y) if self.x and self.y else 0

    def token_sort(self, score) -> int:
        x, y = (" ".join(sorted(t.split())) for t in (self.x, self.y))
        return score(x, y) if x and y else 0

    def token_set(self, score) -> int:
        """Best score among the shared words and the shared words with each side's own."""
        x, y = set(self.x.split()), set(self.y.split())
        if not x or not y:
            return 0
        both, one, two = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
        first, second = f"{both} {one}".strip(), f"{both} {two}".strip()
        return max(score(both, first), score(both, second), score(first, second))

    def wratio(self) -> int:
        """Weighted best of the ratios; partial ones count where one text is half as long again as the other."""
        x, y = self.x, self.y
        if not x or not y:
            return 0
        base, size = self.plain(x, y), max(len(x), len(y)) / min(len(x), len(y))
        if size < 1.5:
            return round(max(base, 0.95 * self.token_sort(self.plain), 0.95 * self.token_set(self.plain)))
        scale = 0.6 if size > 8 else 0.9
        return round(max(base, scale * self.partial(x, y), 0.95 * scale * self.token_sort(self.partial), 0.95 * scale * self.token_set(self.partial)))


FUZZ = {
    "fuzz_qratio": Ratios.qratio, "fuzz_WRatio": Ratios.wratio, "fuzz_partial_ratio": lambda r: r.partial(r.a, r.b),
    "fuzz_partial_token_set_ratio": lambda r: r.token_set(r.partial), "fuzz_partial_token_sort_ratio": lambda r: r.token_sort(r.partial),
    "fuzz_token_set_ratio": lambda r: r.token_set(r.plain), "fuzz_token_sort_ratio": lambda r: r.token_sort(r.plain),
}


@pandas_udf(T.DoubleType())
def diff_ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([sequence_ratio(x.lower(), y.lower()) for x, y in zip(a, b, strict=True)], dtype="float64")


@pandas_udf(T.StructType([T.StructField(n, T.IntegerType()) for n in FUZZ]))
def fuzzy(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([[f(r) for f in FUZZ.values()] for r in map(Ratios, a, b)], columns=list(FUZZ)).astype("int32")
