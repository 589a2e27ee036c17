"""Phrase collocation mining: all 1..max_n-grams as rows, counted a language, scored by their weakest cut.

Each task turns its texts into rows (lang, phrase, count) of n-grams, summed inside bounded
buffers, so that a phrase in every document sends one row a buffer. A hash aggregate per
language gives exact counts. Words and pairs go first; of longer n-grams, those with an infrequent part
never become rows, as they cannot be frequent. Candidates join the counts of their two parts at each
cut, are scored in decimals, lose those that a one-word extension holds often enough, and the best of
a language are ranked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.common import materialize, tidy
from pairloom.llm.words import MARK, Numbers, byte_table, slices, utf8

STOPS = ".,;:!?\n\x0b\x0c\r"
#: Words are parted by spaces and tabs only.
WORDS = byte_table("".join(chr(c) for c in range(128) if chr(c) not in STOPS + " \t"), " \t", STOPS)
MIN_COUNT, MAX_WORDS, TOP, HELD_SHARE = 10, 3, 2000, 50
#: Bounds of the bitmap of frequent phrases, as powers of two of its bits: 8 MB at most.
KEY_BITS = (12, 26)
#: Words in a buffer; longer documents take several, n-grams across their ends included.
BUFFER = 2_000_000

COUNTS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])


@dataclass
class KnownPhrases:
    """A bitmap of hashed phrases: says yes to all of them, and to few others while it is not full. Its size is bounded."""

    bits: np.ndarray

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes & np.uint64(64 * len(self.bits) - 1)
        return (self.bits[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def phrase_hashes(lang: str, *words: np.ndarray) -> np.ndarray:
    """64-bit hashes of phrases from those of their words, in order."""
    h = np.full(len(words[0]), xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass")), np.uint64)
    for w in words:
        h = (h ^ w) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def known_phrases(phrases: DataFrame) -> KnownPhrases:
    """The bitmap of phrases (lang, phrase), of about 16 bits each, within KEY_BITS; set bits are joined before they are collected."""
    size = 1 << min(KEY_BITS[1], max(KEY_BITS[0], math.ceil(math.log2(16 * phrases.count() + 1))))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [int(phrase_hashes(lang, *word_hashes(phrase.encode("utf-8", "surrogatepass").split(b" ")).reshape(-1, 1))[0]) & (size - 1) for lang, phrase in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["b"])

    bits = np.zeros(size >> 6, np.uint64)
    marked = phrases.select("lang", "phrase").mapInArrow(places, "b bigint").groupBy(F.shiftright("b", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("bits"))
    for r in marked.collect():  # a row 64 bits at most: 2^20 rows
        bits[r["word"]] = r["bits"] & 0xFFFFFFFFFFFFFFFF
    return KnownPhrases(bits)


def gram_rows(docs: DataFrame, sizes: range, known: KnownPhrases | None = None) -> DataFrame:
    """(lang, phrase, f) of docs(lang, body): occurrences in a buffer of each n-gram with n in sizes, and with phrase '' of all words.

    known: if given, n-grams of which a part one word shorter than the smallest of sizes is unknown are left out.
    """
    longest = max(sizes)
    shared = docs.sparkSession.sparkContext.broadcast(known)

    @tidy
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[str, Numbers] = {}  # words of the buffer, MARK at 0
        parts: dict[str, list[np.ndarray]] = {}
        counted: dict[str, int] = {}  # leading places that an earlier buffer has counted
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held
            for lang, found in parts.items():
                yield from gram_counts(lang, np.concatenate(found), counted.get(lang, 0), list(numbers[lang]), sizes, shared.value)
            numbers.clear(), parts.clear(), counted.clear()
            held = 0

        def carry_on(lang: str) -> Iterator[pa.RecordBatch]:
            """Flush inside a document, whose last words then lead the next buffer."""
            found, words = np.concatenate([np.zeros(0, np.int64), *parts[lang][1 - longest :]]), list(numbers[lang])
            tail = [words[i] for i in found[max(0, len(found) - longest + 1) :]]
            yield from flush()
            own = numbers.setdefault(lang, Numbers({MARK: 0}))
            parts[lang] = [np.asarray([own[w] for w in tail], np.int64)]
            counted[lang] = len(tail)

        for batch in batches:
            for lang, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for part in slices(body.as_py().translate(WORDS)):
                    own, words = numbers.setdefault(lang, Numbers({MARK: 0})), part.replace(MARK, b" \xff ").split()
                    if not words:
                        continue
                    parts.setdefault(lang, []).append(np.fromiter(map(own.__getitem__, words), np.int64, len(words)))
                    held += len(words)
                    if held >= BUFFER:
                        yield from carry_on(lang)
                if lang in parts:
                    parts[lang].append(np.zeros(1, np.int64))
        yield from flush()

    return docs.select("lang", "body").mapInArrow(explode, "lang string, phrase string, f bigint")


def gram_counts(lang: str, ids: np.ndarray, counted: int, words: list[bytes], sizes: range, known: KnownPhrases | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of the n-grams of ids (0 ends a piece) that end at place `counted` or later; words: those of the ids."""
    texts, hashes = utf8(pa.array(words, pa.binary())), None if known is None else word_hashes(words)

    def rows(phrase: pa.Array, f: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.DictionaryArray.from_arrays(np.zeros(len(f), np.int32), [lang]).cast(pa.string()), phrase, pa.array(f)], schema=COUNTS)

    if 1 in sizes:
        yield rows(pa.array([""]), np.array([np.count_nonzero(ids[counted:])]))
    code = ids
    for n in range(1, max(sizes) + 1):
        if n > 1:  # number: of the (n-1)-gram that ends at a place, 0 for none or an unknown one
            code = np.zeros(len(ids), np.int64)
            code[1:] = np.where((number[:-1] > 0) & (number[1:] > 0), number[:-1] * len(words) + ids[1:], 0)
        place = np.flatnonzero(code)
        _, at, dense = np.unique(code[place], return_index=True, return_inverse=True)
        at = place[at]  # where each different n-gram ends first
        if n in sizes:
            f = np.bincount(dense[place >= counted], minlength=len(at))
            some = np.flatnonzero(f)
            text = [texts.take(pa.array(ids[at[some] - k])) for k in reversed(range(n))]
            yield rows(pc.binary_join_element_wise(*text, pa.scalar(" ", pa.string())) if n > 1 else text[0], f[some])
        number = np.zeros(len(ids), np.int64)
        number[place] = dense + 1
        if known is not None and n == min(sizes) - 1:
            there = known(phrase_hashes(lang, *(hashes[ids[at - k]] for k in reversed(range(n)))))
            number[place] *= there[dense]


def phrase_counts(docs: DataFrame, text: str, lang: str, max_words: int, min_count: int) -> DataFrame:
    """(lang, phrase, f) of the 1..max_words-grams that occur min_count times or more; phrase '' counts all words.

    All words and pairs are counted. A longer n-gram is only counted where its two parts of n - 1 words are frequent,
    as it cannot be so otherwise: tasks ask a bitmap of bounded size, which at worst (full) leaves out nothing.
    """
    slim = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))

    def counted(rows: DataFrame, label: str) -> DataFrame:
        # tasks have summed their rows already, and most phrases occur once: a map-side sum would only spill
        return materialize(rows.repartition("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("f").alias("f")).filter(F.col("f") >= min_count), label)

    levels = [counted(gram_rows(slim, range(1, min(max_words, 2) + 1)), "phrases")]
    for n in range(3, max_words + 1):
        shorter = levels[-1].filter(F.size(F.split("phrase", " ")) == n - 1)
        levels.append(counted(gram_rows(slim, range(n, n + 1), known_phrases(shorter)), "phrases"))
    return reduce(DataFrame.union, levels)


def mine_collocations(docs: DataFrame, text: str = "text", lang: str = "lang", max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, held_share: int = HELD_SHARE, top: int = TOP) -> DataFrame:
    """The `top` phrases of 2..max_words words of each language by score.

    Returns lang, rank, phrase, a, l, r, n, score: a counts the phrase, l and r the two parts at its
    weakest cut, n all words of the language; score is floor(10^6 a a / (l r)). A phrase that occurs in
    a longer one with held_share percent of its count or more goes: such a longer phrase implies one that
    is longer by a word, so one-word extensions decide. Null texts are empty, null languages `und`; empty
    texts and tables give no rows; repeated rows count as often as they occur; ties go by a, then by the
    phrase's bytes; other columns are not read. Decimals of 38 digits keep products exact for counts of
    up to 10^15.
    """
    frequent = phrase_counts(docs, text, lang, max_words, min_count).withColumn("words", F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " "))))
    candidates = frequent.filter("words > 1").select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = candidates.select("*", F.explode(F.expr("sequence(1, size(w) - 1)")).alias("k")).select(
        "lang", "phrase", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("left"), F.expr("array_join(slice(w, k + 1, size(w) - k), ' ')").alias("right")
    )
    part = lambda name, f: frequent.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    score = F.expr("cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    scored = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).withColumn("score", score)
    weakest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = F.explode(F.array(F.expr("array_join(slice(w, 1, size(w) - 1), ' ')"), F.expr("array_join(slice(w, 2, size(w) - 1), ' ')")))
    longer = candidates.filter("size(w) > 2").select("lang", F.col("a").alias("longer"), inner.alias("phrase")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    held = candidates.select("lang", "phrase", "a").join(longer, ["lang", "phrase"]).filter(100 * F.col("longer") >= held_share * F.col("a")).select("lang", "phrase")
    words = frequent.filter("words = 0").select("lang", F.col("f").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    best = weakest.join(held, ["lang", "phrase"], "left_anti").select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return best.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
