"""Exact token counts at every prefix of a text, by dynamic programming over BPE pieces.

A merge-by-score BPE has the property that a token sequence is its encoding if and only if
every two neighbours are the encoding of their concatenation. So the encoding of a prefix
ends in the one piece t for which the last piece of the rest's encoding and t are such
neighbours, and count[i] = count[i - len(t)] + 1. One left-to-right pass stores the count at
every prefix; truncation ("how many tokens has text[:n]") and budget ("longest prefix of at
most b tokens") questions are then lookups, and no text is encoded again.

No piece holds a space after another character, and none holds a newline, so a text falls
apart at those places. Short chunks share the states of their prefixes and their totals are kept; a long
chunk is counted by position in two arrays, in time and memory linear in its length.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import tidy

SPACE = "▁"
CHUNKS = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
# Bounds of a Python worker's caches: entries, and characters of a chunk that is kept.
KEPT_CHUNKS, KEPT_PREFIXES, KEPT_PAIRS, SHORT = 300_000, 500_000, 500_000, 48
ONE = (1,)


class _Totals(dict):
    """Chunk -> its last prefix count, filled on demand."""

    def __init__(self, of: PrefixCounter):
        super().__init__({"\n": 1})
        self.of = of

    def __missing__(self, chunk: str) -> int:
        if len(chunk) > SHORT:
            return self.of.counts(chunk)[-1]
        if len(self) >= KEPT_CHUNKS:
            self.clear()
            self["\n"] = 1
        n = self[chunk] = self.of.state(chunk)[0]
        return n


class _Alone(dict):
    """Piece -> whether it is the encoding of its own text, filled on demand; at most the vocabulary."""

    def __init__(self, of: PrefixCounter):
        super().__init__()
        self.of = of

    def __missing__(self, piece: str) -> bool:
        known = self[piece] = len(piece) == 1 or self.of.split(piece) is not None
        return known


class PrefixCounter:
    """Prefix token counts for one sentencepiece BPE model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.model = model
        self.score: dict[str, float] = {}
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
                self.score[model.id_to_piece(i)] = model.get_score(i)
        spaced = [p for p in self.score if SPACE in p.lstrip(SPACE) or "\n" in p or " " in p]
        if spaced:
            raise ValueError(f"pieces with inner spaces, so texts can't be cut at spaces: {spaced[:3]}")
        # lengths of the pieces with the same last two characters, longest first
        found: dict[str, set[int]] = {}
        for piece in self.score:
            if len(piece) > 1:
                found.setdefault(piece[-2:], set()).add(len(piece))
        self.lengths = {tail: (*sorted(n, reverse=True), 1) for tail, n in found.items()}
        self.states: dict[str, tuple[int, str]] = {"": (0, "")}
        self.totals = _Totals(self)
        self.alone = _Alone(self)
        self.joined: dict[tuple[str, str], bool] = {}
        self.halves: dict[str, tuple[str, str] | None] = {}

    def split(self, piece: str) -> tuple[str, str] | None:
        """The two pieces whose merge made this one; None for a single character."""
        if piece not in self.halves:
            parts = list(piece)
            while len(parts) > 2:
                found = [(s, -i) for i in range(len(parts) - 1) if (s := self.score.get(parts[i] + parts[i + 1])) is not None]
                if not found:
                    break
                at = -max(found)[1]
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            # a longer list: no merge makes this piece, so it never occurs
            self.halves[piece] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.halves[piece]

    def neighbours(self, left: str, right: str) -> bool:
        """Whether [left, right] is the encoding of left + right: no merge across the seam comes first."""
        key = (left, right)
        known = self.joined.get(key)
        if known is None:
            if len(self.joined) >= KEPT_PAIRS:
                self.joined.clear()
            known = self.joined[key] = self._neighbours(left, right)
        return known

    def _neighbours(self, left: str, right: str) -> bool:
        score, limit = self.score, -1e30  # a merge across the seam wins if its score is above the limit
        while True:
            across = score.get(left + right)
            if across is not None and across > limit:
                return False
            # undo the later of the two sides' last merges
            a, b = (score[left] if len(left) > 1 else None), (score[right] if len(right) > 1 else None)
            if a is None and b is None:
                return True
            if b is None or (a is not None and a < b):
                # left of the seam, an equal score would merge first, so across must beat it
                limit, left = a, self.split(left)[1]
            else:
                # right of the seam, the merge across is further left and wins a tie
                limit, right = b - 1e-9, self.split(right)[0]

    def state(self, text: str) -> tuple[int, str]:
        """(tokens, last piece) of a prefix of a chunk, from those of its shorter prefixes."""
        states = self.states
        known = states.get(text)
        if known is not None:
            return known
        if len(states) >= KEPT_PREFIXES:
            states.clear()
            states[""] = (0, "")
        n = len(text)
        have = n - 1
        while text[:have] not in states:
            have -= 1
        score, lengths, neighbours, alone, joined = self.score, self.lengths, self.neighbours, self.alone, self.joined
        for end in range(have + 1, n + 1):
            for size in lengths.get(text[max(0, end - 2) : end], ONE):
                start = end - size
                if start < 0:
                    continue
                piece = text[start:end]
                if piece in score:
                    if not alone[piece]:
                        continue
                    before = states.get(text[:start]) or self.state(text[:start])
                    fits_on = joined.get((before[1], piece)) if start else True
                    if neighbours(before[1], piece) if fits_on is None else fits_on:
                        found = (before[0] + 1, piece)
                        break
                elif end - start == 1:
                    # a character outside the vocabulary: its UTF-8 bytes, one token each
                    found = (self.state(text[:start])[0] + len(piece.encode("utf-8", "surrogatepass")), piece)
                    break
            else:
                raise AssertionError(f"no last piece for {text[:end]!r}")
            states[text[:end]] = found
        return found

    def counts(self, chunk: str) -> array:
        """counts[i] for i = 0..len(chunk): the same recurrence, with states by position."""
        n, score, lengths, neighbours = len(chunk), self.score, self.lengths, self.neighbours
        counts, begin = array("q", bytes(8 * (n + 1))), array("q", bytes(8 * (n + 1)))  # begin: of the last piece
        for end in range(1, n + 1):
            for size in lengths.get(chunk[max(0, end - 2) : end], ONE):
                start = end - size
                if start < 0:
                    continue
                piece = chunk[start:end]
                if piece in score:
                    if self.alone[piece] and (start == 0 or neighbours(chunk[begin[start] : start], piece)):
                        counts[end], begin[end] = counts[start] + 1, start
                        break
                elif end - start == 1:
                    counts[end], begin[end] = counts[start] + len(piece.encode("utf-8", "surrogatepass")), start
                    break
            else:
                raise AssertionError(f"no last piece before {end}")
        return counts

    def table(self, chunk: str) -> list[int] | array:
        """counts[i] for i = 0..len(chunk)."""
        if chunk == "\n":
            return [0, 1]
        return self.counts(chunk) if len(chunk) > SHORT else [self.state(chunk[:i])[0] for i in range(len(chunk) + 1)]

    def pieces(self, text: str) -> list[str]:
        """The chunks of a text after the model's normalisation (identity, with a space put before)."""
        return CHUNKS.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def total(self, text: str) -> int:
        """Tokens of the whole text: the last entry of its prefix table."""
        return sum(map(self.totals.__getitem__, self.pieces(text)))

    def prefix_counts(self, text: str) -> array:
        """counts[n] = tokens of text[:n], for n = 0..len(text)."""
        out, base = array("i", [0]), 0
        first = True
        for c in self.pieces(text):
            t = self.table(c)
            # the space put before the text is no character of it; an empty prefix has no tokens
            out.extend(base + t[i] for i in range(2 if first else 1, len(t)))
            base, first = base + t[-1], False
        return out


def fits(counts: array, budget: int) -> int:
    """Characters of the longest prefix that has at most `budget` tokens and every shorter one too."""
    # running maximum: counts can fall by one where a longer piece takes over
    top, highest = [], 0
    for c in counts:
        highest = max(highest, c)
        top.append(highest)
    return max(0, bisect_right(top, budget) - 1)


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def model_path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def prefix_token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str | None = None, store: bool = True, budget: int | None = None) -> DataFrame:
    """Token counts of every whole text by the prefix table.

    Returns key, n_bytes, n_tokens and, with store, `counts`: the tokens of each prefix by
    characters, entry n for text[:n]; with a budget, `fit_chars`: the longest prefix within
    it. Null and empty texts have no bytes, no tokens and the table [0]. Repeated rows are
    counted each; a text without spaces or newlines of any length takes time and memory in proportion; other columns are not read.
    """
    schema = pa.schema([("key", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())] + [("counts", pa.list_(pa.int32()))] * store + [("fit_chars", pa.int64())] * (budget is not None))

    @tidy
    def count(rows):
        c = counter(model_path(model))
        for batch in rows:
            keys = batch.column(0)
            made = {"n_bytes": [], "n_tokens": [], "counts": [], "fit_chars": []}
            for x in batch.column(1):
                t = x.as_py() or ""
                made["n_bytes"].append(len(t.encode("utf-8", "surrogatepass")))
                if store or budget is not None:
                    counts = c.prefix_counts(t)
                    made["n_tokens"].append(counts[-1])
                    made["counts"].append(counts if store else None)
                    made["fit_chars"].append(fits(counts, budget) if budget is not None else None)
                else:
                    made["n_tokens"].append(c.total(t))
            yield pa.RecordBatch.from_arrays([keys] + [pa.array(made[f.name], f.type) for f in schema if f.name != "key"], schema=schema)

    out = "key bigint, n_bytes bigint, n_tokens bigint" + ", counts array<int>" * store + ", fit_chars bigint" * (budget is not None)
    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(count, out).withColumnRenamed("key", key)
