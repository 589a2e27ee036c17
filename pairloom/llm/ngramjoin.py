"""Word n-gram Jaccard join by PartEnum signatures, and the components of its links.

Sets whose sizes can pair lie in one size band or two adjoining ones. In a band, two sets with
Jaccard similarity of at least the threshold differ in at most k shingles. The shingle domain
is hashed into n1 parts, and each part into n2 smaller ones. If n1 parts hold at most k
differences, one of them holds at most k / n1 = f of them, so the two sets agree in some n2 - f
smaller parts of it: each set signs every subset of that size of every part with
(band, part, subset, hash of its shingles there). The numbers are chosen by the band (parameters()). Parts that
hold few shingles tell little, so every set leaves out its e thinnest parts and n1 has 2e parts more: no
link is lost. Sets that share a signature form families. In these, parities of hashed cells
bound the difference of two sets from below, which splits the families without their shingles
and without losing a link; in what is left an exact intersection decides every pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import discard, matching, materialize, release, row_hash, split_by_keys, tidy
from pairloom.llm.linking import Forest, connected, family_links, star_edges
from pairloom.llm.rolling import word_hashes

BAND = 1.4  # ratio of a size band's ends
ONE_PART = 4  # most differences for which the whole domain is one part
MOST_SIGNATURES = 0.3  # of the size of a band's largest set, above which parts aren't cut into smaller ones
KEPT_TEXTS = 200_000  # texts of a task that are remembered as signed
SKETCH_BLOCK, SKETCH_BYTES = 16384, 1 << 22  # most items, and bytes, of one side of a block when only sketches are compared
LEAST_CELLS = 64  # bits of the smallest parity sketch
_MIX, _ADD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def shingles_of(text: str, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes; with fewer words, one hash of all of them; none without words."""
    h = word_hashes(text)
    n = len(h)
    if not n:
        return h
    w = min(width, n)
    out = np.full(n - w + 1, w if n < width else 0, np.uint64)
    for i in range(w):
        out = _mix(out * _ADD + h[i : n - w + 1 + i])
    out.sort()
    new = np.ones(len(out), bool)
    np.not_equal(out[1:], out[:-1], out=new[1:])
    return out[new]


def difference_bound(size: int, percent: int) -> int:
    """Most shingles in which two sets of up to `size` shingles can differ at that similarity."""
    return (100 - percent) * 2 * size // (100 + percent)


def bands_of(size: int, percent: int) -> list[int]:
    """Bands in which a set signs: its own, and higher ones where a larger partner can lie."""
    own = int(math.log(size) / math.log(BAND) + 1e-9)
    out, band = [own], own + 1
    while 100 * size >= percent * math.ceil(BAND**band):
        out.append(band)
        band += 1
    return out


@lru_cache(maxsize=256)
def parameters(band: int, percent: int) -> tuple[int, int, int, int]:
    """(n1, n2, smaller parts in a signature, parts left out) of a band.

    Few differences: one part, cut into k + 2, of which each two are signed. More: parts of
    which one has at most one difference, cut into three, of which each two are signed; or, where that makes too many
    signatures, parts of which one has no difference, signed whole.
    """
    top = math.ceil(BAND ** (band + 1))
    k = difference_bound(top, percent)
    if not k:
        return 1, 1, 1, 0
    if k <= ONE_PART:
        return 1, k + 2, 2, 0
    needed = -(-(k + 1) // 2)
    spare = max(1, int(0.06 * needed))
    if 3 * (needed + spare) <= MOST_SIGNATURES * top + 6:
        return needed + 2 * spare, 3, 2, spare
    spare = max(1, int(0.1 * (k + 1)))
    return k + 1 + 2 * spare, 1, 1, spare


def signatures(shingles: np.ndarray, percent: int) -> np.ndarray:
    """64-bit signatures of a set."""
    if not len(shingles):
        return np.empty(0, np.int64)
    mixed = _mix(shingles + _ADD)
    high, low = mixed >> np.uint64(32), mixed & np.uint64(0xFFFFFFFF)
    out = []
    for band in bands_of(len(shingles), percent):
        n1, n2, chosen, spare = parameters(band, percent)
        cell = ((high * np.uint64(n1) >> np.uint64(32)) * np.uint64(n2) + (low * np.uint64(n2) >> np.uint64(32))).astype(np.int64)
        count = np.bincount(cell, minlength=n1 * n2).reshape(n1, n2)
        total = np.zeros(n1 * n2, np.uint64)
        np.add.at(total, cell, mixed)  # order-free hash of a cell's shingles
        total = total.reshape(n1, n2)
        keep = np.arange(n1)
        if spare:  # a part's thinnest signature holds its smallest smaller parts
            thin = np.sort(count, 1)[:, :chosen].sum(1)
            keep = np.sort(np.argsort(-thin, kind="stable")[: n1 - spare])
        for number, subset in enumerate(combinations(range(n2), chosen)):
            held, size = total[keep, subset[0]], count[keep, subset[0]]
            for i in subset[1:]:
                held, size = held + total[keep, i], size + count[keep, i]
            name = _mix((keep * 64 + number).astype(np.uint64) * _ADD + np.uint64(band))
            out.append(_mix(held + name + size.astype(np.uint64)).view(np.int64))
    return np.concatenate(out)


def item_of(shingles: np.ndarray) -> int:
    """64-bit name of a set."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def parities(shingles: np.ndarray) -> bytes:
    """Bit i: parity of the shingles hashed to cell i. Two sets differ in no fewer shingles than bits.

    The cells are a power of two and at least as many as shingles; the two halves of a sketch, one put on the other, are the
    sketch with half the cells.
    """
    cells = max(LEAST_CELLS, 1 << (len(shingles) - 1).bit_length())
    at = ((shingles >> np.uint64(20)) & np.uint64(cells - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=cells) & 1).astype(np.uint8), bitorder="little").tobytes()


def _folded(bits: np.ndarray) -> np.ndarray:
    """Sketches (rows of 64-bit words) with half the cells; a single word has no half and matches itself only."""
    half = bits.shape[1] // 2
    return bits[:, :half] ^ bits[:, half:] if half else bits


FACTS = pa.schema([("key", pa.int64()), ("row", pa.int64()), ("n_shingles", pa.int64()), ("item", pa.int64()), ("sketch", pa.binary())])


def shingle_facts(docs: DataFrame, width: int) -> DataFrame:
    """From (key, row, text): size, 64-bit hash of the set (item, null if empty) and its sketch."""

    @tidy
    def facts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out: list[list] = [[], [], []]
            for x in batch.column(2):
                s = shingles_of(x.as_py() or "", width)
                for o, v in zip(out, (len(s), item_of(s), parities(s)) if len(s) else (0, None, None), strict=True):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(o, f.type) for o, f in zip(out, list(FACTS)[2:], strict=True)]], schema=FACTS)

    return docs.mapInArrow(facts, "key bigint, row bigint, n_shingles bigint, item bigint, sketch binary")


def signer(width: int, percent: int):
    """sign() for star_edges on a text column; most copies of a text inside a task sign once."""

    def sign(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        seen: set[int] = set()
        for batch in it:
            for x in batch.column(0):
                text = x.as_py()
                h = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
                if h in seen:
                    continue
                if len(seen) >= KEPT_TEXTS:
                    seen.clear()
                seen.add(h)
                s = shingles_of(text, width)
                if len(s):
                    keys = signatures(s, percent)
                    yield keys, np.full(len(keys), item_of(s), np.int64), np.zeros(len(keys), np.int8)

    return sign


def possible_links(percent: int):
    """verify() for family_links: pairs that sizes and sketches don't rule out, as a spanning forest."""

    def levels(side: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """words of a sketch -> (positions, sketches, sketches with half the cells)."""
        sketches = side["sketch"].to_pylist()
        words = np.fromiter(map(len, sketches), np.int64, len(sketches)) // 8
        out = {}
        for w in np.unique(words).tolist():
            at = np.flatnonzero(words == w)
            bits = np.frombuffer(b"".join([sketches[i] for i in at.tolist()]), np.uint64).reshape(len(at), w)
            out[w] = at, bits, _folded(bits)
        return out

    def verify(x: pa.Table, y: pa.Table | None) -> Iterator[tuple[int, int]]:
        left = levels(x)
        right = left if y is None else levels(y)
        sizes = x["n_shingles"].to_numpy(), (x if y is None else y)["n_shingles"].to_numpy()
        n = len(x)
        forest = Forest(n + (0 if y is None else len(y)))
        for w, (at, bits, halves) in left.items():
            for i, own, half in zip(at.tolist(), bits, halves, strict=True):
                for v in (w // 2, w, 2 * w):  # sets of other sizes can't be similar enough
                    if v not in right:
                        continue
                    there, bits2, halves2 = right[v]
                    differ = np.bitwise_count(bits2 ^ own if v == w else halves2 ^ own if v > w else bits2 ^ half).sum(1, dtype=np.int64)
                    a, b = sizes[0][i], sizes[1][there]
                    near = (100 * np.minimum(a, b) >= percent * np.maximum(a, b)) & ((100 + percent) * differ <= (100 - percent) * (a + b))
                    if y is None:
                        near &= there > i
                    for j in there[near].tolist():
                        if forest.join(i, j if y is None else n + j):
                            yield i, j

    return verify


def linked_sets(percent: int):
    """verify() for family_links: exact Jaccard of sorted hash arrays."""

    def verify(x: pa.Table, y: pa.Table | None) -> Iterator[tuple[int, int]]:
        left = [s.values.to_numpy() for s in x["shingles"]]
        right = left if y is None else [s.values.to_numpy() for s in y["shingles"]]
        if y is None and len(left) == 2:
            n = len(np.intersect1d(left[0], left[1], assume_unique=True))
            if 100 * n >= percent * (len(left[0]) + len(left[1]) - n):
                yield 0, 1
            return
        # shingles of one set only meet nothing: the rest are the columns of two 0/1 matrices
        values, times = np.unique(np.concatenate(left if y is None else left + right), return_counts=True)
        shared = values[times > 1]
        sizes = np.array([len(s) for s in left]), np.array([len(s) for s in right])
        found = np.zeros((len(left), len(right)), np.float32)
        for at in range(0, len(shared), 4096):  # column slabs, so memory is bounded for any text length
            slab = shared[at : at + 4096]
            a = _matrix(left, slab)
            found += a @ (a if y is None else _matrix(right, slab)).T
        common = found.astype(np.int64)
        hit = 100 * common >= percent * (sizes[0][:, None] + sizes[1][None, :] - common)
        if y is None:
            hit = np.triu(hit, 1)
        yield from zip(*(i.tolist() for i in np.nonzero(hit)), strict=True)

    return verify


def _matrix(sets: list[np.ndarray], slab: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(slab)), np.float32)
    for i, s in enumerate(sets):
        lo, hi = np.searchsorted(s, (slab[0], slab[-1]), "left")
        part = s[lo : hi + 1]
        at = np.searchsorted(slab, part)
        ok = at < len(slab)
        ok[ok] = slab[at[ok]] == part[ok]
        out[i, at[ok]] = 1
    return out


def size_windows(families: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """(item, family, room) with every family cut into windows of two neighbouring size classes.

    The sizes of two linked sets differ by less than a class is wide, so they share a window.
    """
    width = math.log(100 / percent) * 1.0001
    size_class = F.floor(F.log(F.col("n_shingles").cast("double")) / F.lit(width))
    # a sketch has at most two bits a shingle, and a window's largest set is below the end of class c + 1
    room = F.least(F.lit(SKETCH_BLOCK), F.greatest(F.lit(256), F.lit(4 * SKETCH_BYTES) / F.exp((F.col("c") + 2) * width))).cast("int")
    return families.join(sizes.select("item", size_class.alias("c")), "item").select("item", "family", F.explode(F.array(F.col("c") - 1, F.col("c"))).alias("c")).select("item", F.xxhash64("family", "c").alias("family"), room.alias("room"))


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """key, n_shingles, component_id (smallest key reachable by links), row and first of every row.

    Rows link when 100 * common >= percent * union of their sets of word shingles (words:
    runs of non-space, A-Z lower-cased). Null and wordless texts have empty sets and are
    linked with nothing. Equal sets link; rows that repeat a key are documents of their own, told apart by
    row (row_hash) unless their texts are equal, too. first marks the smallest (key, row) of a
    component, null keys last. A component of null keys alone has a null component_id. An empty
    table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    chosen = docs.select(F.col(key).cast("long").alias("key"), row_hash(key, text).alias("row"), F.col(text).alias("text"))
    facts = materialize(shingle_facts(chosen, width), "shingles")
    # equal sets are one item from here on
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    items = facts.filter("item is not null")
    ties = materialize(star_edges(chosen.select("text").filter("text is not null"), signer(width, percent), parts), "ties")
    release(spark)
    wide = materialize(connected(ties, "family"), "families")
    discard(ties)
    tied = split_by_keys(items, ["item"], wide, ["item"])[0]
    sketches = materialize(tied.groupBy("item").agg(F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n_shingles")), "sketches")
    possible = materialize(family_links(size_windows(wide, sketches, percent), sketches, possible_links(percent)), "possible")
    families = materialize(connected(possible, "family"), "families")
    # the sets of items in families only, made again from one text each
    named = split_by_keys(items.select("key", "row", "item"), ["item"], families, ["item"])[0]
    wanted = named.join(families.select("item"), "item", "left_semi").groupBy("item").agg(F.min(F.struct("key", "row")).alias("at"))
    wanted = materialize(wanted.select("item", F.col("at.key").alias("k"), F.col("at.row").alias("r")), "wanted")

    @tidy
    def sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out: list[list] = [[], []]
            for item, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out[0].append(item), out[1].append(np.sort(shingles_of(x.as_py() or "", width).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.int64()))], names=["item", "shingles"])

    texts = matching(split_by_keys(chosen, ["key", "row"], wanted, ["k", "r"])[0], wanted, {"key": "k", "row": "r"}, "inner")
    payload = texts.select("item", "text").dropDuplicates(["item"]).mapInArrow(sets, "item bigint, shingles array<bigint>")
    links = materialize(family_links(families, payload, linked_sets(percent)), "links")
    classes = materialize(connected(links, "class"), "classes")
    # a component: a class of linked items, or the copies of one item
    at = F.struct(F.col("key").isNull().alias("none"), "key", "row")
    first = items.groupBy("item").agg(F.min(at).alias("at"), F.count(F.lit(1)).alias("n"))
    grouped = first.join(classes, "item", "left").filter((F.col("n") > 1) | F.col("class").isNotNull()).withColumn("class", F.coalesce("class", "item"))
    grouped = materialize(grouped.select("item", "at", "class"), "grouped")
    smallest = grouped.groupBy("class").agg(F.min("at").alias("at"))
    by_item = materialize(grouped.select("item", "class").join(smallest, "class").select("item", "at"), "first")
    discard(possible)
    discard(sketches)
    alone, joined = F.col("at").isNull(), facts.join(by_item, "item", "left")
    own = F.col("key").eqNullSafe(F.col("at.key")) & (F.col("row") == F.col("at.row"))
    return joined.select(F.col("key").alias(key), "n_shingles", F.when(alone, F.col("key")).otherwise(F.col("at.key")).alias("component_id"), "row", (alone | own).alias("first"))
