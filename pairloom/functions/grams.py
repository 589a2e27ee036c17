"""Counts over n-grams that need a multiset or bit sums: in Arrow batches, linear in the grams."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

KEPT_GRAMS = 200_000
SIMHASH_KINDS = ("tokenize", "word_2gram", "char_2gram", "word_3gram", "char_3gram")
OVERLAPS = [f"{what}{n}" for n in (1, 2, 3) for what in ("shared", "either", "low", "total")]


def _words(tokens: list[str], n: int) -> list[str]:
    return [" ".join(tokens[i : i + n]) for i in range(len(tokens) - n + 1)]


def _chars(text: str, n: int) -> list[str]:
    return [text[i : i + n] for i in range(len(text) - n + 1)]


class GramBits(dict):
    """Gram -> its 64 hash bits as -1 and 1, filled on demand: the last 8 bytes of its MD5."""

    def __missing__(self, gram: str) -> np.ndarray:
        if len(self) >= KEPT_GRAMS:
            self.clear()
        raw = np.frombuffer(hashlib.md5(gram.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()[8:], np.uint8)
        out = self[gram] = np.unpackbits(raw).astype(np.int16) * 2 - 1
        return out


def simhash(grams: list[str], bits: GramBits) -> np.ndarray:
    """64 booleans: where the signed bits of the grams sum to more than 0; all false without grams."""
    return np.sum([bits[g] for g in grams], axis=0) > 0 if grams else np.zeros(64, bool)


@pandas_udf(T.StructType([T.StructField(n, T.IntegerType()) for n in SIMHASH_KINDS]))
def simhash_distances(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Hamming distances of the simhashes of two token arrays, over tokens, word and character n-grams."""
    bits, rows = GramBits(), []

    def kinds(tokens: list[str]) -> list[np.ndarray]:
        text = " ".join(tokens)
        return [simhash(g, bits) for g in (tokens, _words(tokens, 2), _chars(text, 2), _words(tokens, 3), _chars(text, 3))]

    for x, y in zip(a, b, strict=True):
        rows.append([int((p != q).sum()) for p, q in zip(kinds(list(x)), kinds(list(y)), strict=True)])
    return pd.DataFrame(rows, columns=list(SIMHASH_KINDS)).astype("int32")


@pandas_udf(T.StructType([T.StructField(n, T.IntegerType()) for n in OVERLAPS]))
def gram_overlaps(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """For character 1- to 3-grams: distinct grams in both and in either text, copies in both, copies in all."""
    rows = []
    for x, y in zip(a, b, strict=True):
        row = []
        for n in (1, 2, 3):
            p, q = Counter(_chars(x, n)), Counter(_chars(y, n))
            shared = p.keys() & q.keys()
            row += [len(shared), len(p) + len(q) - len(shared), sum(min(p[g], q[g]) for g in shared), p.total() + q.total()]
        rows.append(row)
    return pd.DataFrame(rows, columns=OVERLAPS).astype("int32")
