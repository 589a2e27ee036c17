"""Benchmark decontamination by template canonicalisation.

Words become template tokens: numbers, units and names (capitalised words) turn into typed
placeholders, everything else is lower-cased. Windows of template tokens of the benchmark are
hashed; a document is hit where its windows hash-join with them. Windows with too few literal
words to tell one text from another are hashed with the values of their slots instead, so they
hit exact copies only. The hits of an item are grouped by placement, the offset between item
and document; each placement is judged by itself: a re-parameterised copy maps every value of a
slot to one value, back and forth, so inconsistent hits, which only share their grammar, are
dropped. What is left counts by the share of the item's windows that were found. Items of under
LEAST_WORDS words, which many texts hold by chance, are found where they are a whole document.

The benchmark is taken in blocks of bounded size, by whole items: each block's index goes to
every task and all documents are searched for it where they lie. A larger benchmark takes more
passes of the same kind; documents are never shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import materialize, row_hash, tidy, without_rows

WINDOW = 8
LITERALS = 4  # a window with fewer words that are no placeholder is hashed by its values
COVERAGE = 0.6  # share of an item's windows that make a leak
CONSISTENT = 0.8  # share of the slots of the hit windows that one mapping explains
LEAST_WORDS = 3
#: Words of benchmark items in a block, about as many windows: what goes to every task at a time.
BLOCK_WORDS = 500_000
TOKEN = re.compile(r"[^\W_]+(?:[.,'][^\W_]+)*|[%$€£°]")
NUMBER = re.compile(r"\d[\d.,]*(?:st|nd|rd|th)?")
DIGIT = re.compile(r"\d")
MEASURE = re.compile(r"(\d[\d.,]*)([^\W\d_]+)")
# Units of measure and number words.
UNITS = frozenset("% $ € £ ° mm cm m km in ft yd mi mg g kg t lb oz ml cl l s ms min h hr hrs sec secs hour hours minute minutes second seconds day days week weeks month months year years meter meters metre metres kilometer kilometers mile miles inch inches foot feet gram grams kilogram kilograms liter liters litre litres dollar dollars euro euros cent cents percent degree degrees kmh mph hz khz mhz ghz kb mb gb tb v kv w kw mw j kj cal kcal".split())
NUMBERS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
KEPT_WORDS, KEPT_ITEMS = 300_000, 5_000
SLOT_BITS = 22


def _parts(word: str) -> tuple[str, ...]:
    m = MEASURE.fullmatch(word)
    return m.groups() if m and m[2].lower() in UNITS else (word,)


class Canonical(dict):
    """Word -> (template hash, 0 for a literal or the slot type 1 number, 2 unit, 3 name, value hash), filled on demand."""

    TYPES = ("", "<number>", "<unit>", "<name>")

    def __missing__(self, word: str) -> tuple[int, int, int]:
        if len(self) >= KEPT_WORDS:
            self.clear()
        low = word.lower()
        if NUMBER.fullmatch(word) or low in NUMBERS:
            kind = 1
        elif low in UNITS and (len(low) > 1 or not word.isalpha()):
            kind = 2
        elif word[:1].isupper() and word[1:].islower():
            kind = 3
        else:
            kind = 0
        value = xxhash.xxh3_64_intdigest(low)
        out = self[word] = (xxhash.xxh3_64_intdigest(self.TYPES[kind]) if kind else value, kind, value)
        return out

    def template(self, text: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Words of a text, their template hashes, slot types and value hashes."""
        words = TOKEN.findall(text)
        if DIGIT.search(text):  # 5km is a number and a unit
            words = [p for w in words for p in _parts(w)]
        got = [self[w] for w in words]
        hashes, kinds = np.array([g[0] for g in got], np.uint64), np.array([g[1] for g in got], np.int8)
        values, slots = hashes.copy(), np.flatnonzero(kinds)
        values[slots] = [got[i][2] for i in slots.tolist()]
        return words, hashes, kinds, values


def has_literals(kinds: np.ndarray, width: int) -> np.ndarray:
    """Whether each window has enough literals to be hashed as a template."""
    literal = np.concatenate(([0], np.cumsum(kinds == 0)))
    return literal[width:] - literal[:-width] >= min(LITERALS, width)


def windows(hashes: np.ndarray, kinds: np.ndarray, values: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows: of templates, or of values where literals are few."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)

    def mix(h: np.ndarray, part: np.ndarray) -> None:
        h *= np.uint64(0xD1B54A32D192ED03)
        h += part
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)

    h = np.full(n, width, np.uint64)
    for i in range(width):
        mix(h, hashes[i : n + i])
    exact = np.flatnonzero(~has_literals(kinds, width))
    if len(exact):
        v = np.full(len(exact), width + 1000, np.uint64)  # never equal to a template by its start value
        for i in range(width):
            mix(v, values[exact + i])
        h[exact] = v
    return h.view(np.int64)


class ItemIndex:
    """Windows of a block of the benchmark by hash, in sorted arrays; items are numbered in the order given."""

    def __init__(self, texts: list[str], width: int = WINDOW):
        self.texts = texts
        self.whole: dict[bytes, list[int]] = defaultdict(list)  # of short items
        canonical, found = Canonical(), defaultdict(list)
        for item, text in enumerate(texts):
            _, hashes, kinds, values = canonical.template(text)
            w = min(width, len(hashes))
            if w >= LEAST_WORDS:
                keys = windows(hashes, kinds, values, w)
                found[w].append((keys, np.full(len(keys), item, np.int32), np.arange(len(keys), dtype=np.int32)))
            elif w:
                self.whole[values.tobytes()].append(item)
        self.parts: dict[int, tuple[np.ndarray, ...]] = {}
        for w, rows in sorted(found.items()):
            keys, items, starts = (np.concatenate(x) for x in zip(*rows, strict=True))
            order = np.argsort(keys, kind="stable")
            maybe = np.zeros(1 << SLOT_BITS - 3, np.uint8)  # a bit for each value of a key's top bits
            slot = keys.view(np.uint64) >> np.uint64(64 - SLOT_BITS)
            np.bitwise_or.at(maybe, slot >> np.uint64(3), np.left_shift(1, slot & np.uint64(7)).astype(np.uint8))
            self.parts[w] = keys[order], items[order], starts[order], maybe
        self.cache: dict[int, tuple[list[str], list[int], list[bool]]] = {}

    def words(self, item: int, width: int) -> tuple[list[str], list[int], list[bool]]:
        """Words of an item, their slot types, and whether each window is a template."""
        got = self.cache.get(item)
        if got is None:
            if len(self.cache) >= KEPT_ITEMS:
                self.cache.clear()
            words, _, kinds, _ = Canonical().template(self.texts[item])
            got = self.cache[item] = words, kinds.tolist(), has_literals(kinds, width).tolist()
        return got

    def hits(self, hashes: np.ndarray, kinds: np.ndarray, values: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """item -> (its window's start, the place in the text, width) of each window that a text shares."""
        hits: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for w, (known, items, starts, maybe) in self.parts.items():
            keys = windows(hashes, kinds, values, w)
            slot = keys.view(np.uint64) >> np.uint64(64 - SLOT_BITS)
            at = np.flatnonzero(maybe[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1)
            low, high = np.searchsorted(known, keys[at], "left"), np.searchsorted(known, keys[at], "right")
            for i, a, b in zip(at.tolist(), low.tolist(), high.tolist(), strict=True):
                for j in range(a, b):
                    hits[int(items[j])].append((int(starts[j]), i, w))
        return hits


def leaks_of(text: str, index: ItemIndex, canonical: Canonical) -> list[tuple[int, float, float]]:
    """(item number, coverage, consistency) of the items that a text holds."""
    words, hashes, kinds, values = canonical.template(text)
    out = [(item, 1.0, 1.0) for item in index.whole.get(values.tobytes(), ())] if len(words) < LEAST_WORDS else []
    return out + [(item, *judged) for item, found in sorted(index.hits(hashes, kinds, values).items()) if (judged := judge(words, found, index, item)) is not None]


def placements(found: list[tuple[int, int, int]], length: int) -> Iterator[list[tuple[int, int, int]]]:
    """Groups of an item's hits that may be one copy of it.

    Hits at one offset are one copy. Words put in or left out shift the rest of a copy, so
    each offset is also tried with what other offsets within the item's length add in the same
    order, nearest first. All hits together come last, for copies in another order.
    """
    by: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for hit in sorted(found):
        by[hit[1] - hit[0]].append(hit)
    ranked = sorted(by, key=lambda d: (-len(by[d]), d))
    for d in ranked:
        yield by[d]
    if len(by) == 1:
        return
    offsets, used = sorted(by), set()
    for d in ranked:
        if d in used:
            continue
        near = offsets[bisect_left(offsets, d - length) : bisect_right(offsets, d + length)]
        chain = list(by[d])
        for e in sorted(near, key=lambda e: (abs(e - d), e)):
            fits = []
            for hit in by[e] if e != d else ():
                i = bisect_left(chain, hit[:1])
                if (i == len(chain) or chain[i][0] > hit[0] and chain[i][1] > hit[1]) and (i == 0 or chain[i - 1][1] < hit[1]):
                    fits.append(hit)
            if fits:
                chain = sorted(chain + fits)
                if len(fits) == len(by[e]):
                    used.add(e)
        if len(chain) > len(by[d]):
            yield chain
    yield found


def judge(words: list[str], found: list[tuple[int, int, int]], index: ItemIndex, item: int) -> tuple[float, float] | None:
    """Coverage and slot consistency of the first placement of an item that passes the limits; None if none does."""
    width = found[0][2]  # an item has windows of one width
    own, kinds, template = index.words(item, width)
    for placed in placements(found, len(own)):
        starts = {start for start, _, _ in placed}
        # windows that are hashed by value can't be hit by changed copies, so templates alone are enough
        coverage = max(len(starts) / len(template), sum(template[s] for s in starts) / max(1, sum(template)))
        if coverage < COVERAGE:
            continue
        # each slot of the item once for each place that it was found at
        slots = {(start + i, at + i) for start, at, w in placed for i in range(w) if kinds[start + i]}
        there: dict[tuple[int, str], dict[str, int]] = defaultdict(lambda: defaultdict(int))
        back: dict[tuple[int, str], dict[str, int]] = defaultdict(lambda: defaultdict(int))
        for i, j in slots:
            there[kinds[i], own[i]][words[j]] += 1
            back[kinds[i], words[j]][own[i]] += 1
        agree = sum(max(v.values()) for v in there.values()) + sum(max(v.values()) for v in back.values())
        consistency = agree / (2 * len(slots)) if slots else 1.0
        if consistency >= CONSISTENT:
            return coverage, consistency
    return None


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", width: int = WINDOW) -> DataFrame:
    """(key, item, coverage, consistency, row) of each document and benchmark item that it holds.

    Null and empty texts hold nothing, null and empty items are never found; an item id with several texts
    is found where one of them is, with the best coverage. Rows that repeat a key are searched each
    and told apart by row (row_hash); rows equal in key and text give one row. Null keys and
    null item ids are kept as such. Tables may be empty. Other columns are not read.
    """
    spark = docs.sparkSession
    chosen = docs.select(F.col(key).cast("long").alias("key"), row_hash(key, text).alias("row"), F.col(text).alias("text"))
    schema = "key bigint, row bigint, item bigint, coverage double, consistency double"
    items = benchmark.select(F.col(item).cast("long").alias("i"), F.col(item_text).alias("t")).filter("t is not null").distinct()
    blocks = max(1, -(-(items.agg(F.sum(F.size(F.split("t", r"\s+")))).first()[0] or 0) // BLOCK_WORDS))
    items = materialize(items.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(blocks))), "items")

    def searcher(shared):
        @tidy
        def search(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (ids, index), canonical = shared.value, Canonical()
            for batch in it:
                cols: list[list] = [[], [], [], []]
                for r, x in enumerate(batch.column(2)):
                    best: dict[int | None, tuple[float, float]] = {}
                    for i, *judged in leaks_of(x.as_py() or "", index, canonical):
                        best[ids[i]] = max(best.get(ids[i], (0.0, 0.0)), tuple(judged))
                    for i, judged in best.items():
                        for c, v in zip(cols, (r, i, *judged), strict=True):
                            c.append(v)
                at = pa.array(cols[0], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(cols[1], pa.int64()), *[pa.array(c, pa.float64()) for c in cols[2:]]], names=["key", "row", "item", "coverage", "consistency"])

        return search

    found = None
    for b in range(blocks):  # one block is live at a time: its leaks are written before the next one is built
        rows = sorted(((r["i"], r["t"]) for r in items.filter(F.col("block") == b).collect()), key=str)
        shared = spark.sparkContext.broadcast(([i for i, _ in rows], ItemIndex([t for _, t in rows], width)))
        one = materialize(chosen.mapInArrow(searcher(shared), schema), "leaks")
        shared.destroy()
        found = one if found is None else found.union(one)
    best = found.groupBy("key", "row", "item").agg(F.max(F.struct("coverage", "consistency")).alias("best"))
    return best.select("key", "item", F.col("best.coverage").alias("coverage"), F.col("best.consistency").alias("consistency"), "row")


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the documents that hold a benchmark item; columns and other rows stay as they are."""
    leaked = find_leaks(docs, benchmark, key, text).select(F.col("key").alias("__key"), F.col("row").alias("__row")).distinct()
    return without_rows(docs, key, text, materialize(leaked, "leaked"))
