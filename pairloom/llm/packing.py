"""Hierarchical multi-length packing of token documents into fixed context windows.

Every document gives full windows of the largest size from its front; what is left is routed
to the smallest tier that holds it. Tiers are packed from the largest down: each document
opens a window of its tier, gaps are filled with whole documents of shorter tiers, longest
that fits first, and the last gap with the front of one more document, whose rest is routed
again. The very last window is cut into power-of-two windows, so nothing is padded. Windows
are then dealt into step groups of near-equal token counts, largest first.

A block of consecutive documents of one input partition is packed at a time: the memory is
bounded by the block, nothing is shuffled, and a lost task is repeated with the same rows
and so gives the same windows.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import tidy
from pairloom.llm.wordbpe import word_bpe

TIERS = (4096, 2048, 1024, 512)
BLOCK_TOKENS = 1_000_000
STEP_TOKENS = 16 * 4096


def tokenizer_path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def plan_windows(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[tuple[int, int, int]]]:
    """Windows of (document, start, length) pieces; every id of every document lies in one piece.

    Every window is exactly full, at a tier's size or at a smaller power of two.
    """
    top = tiers[0]
    windows: list[list[tuple[int, int, int]]] = []
    pools: list[list[tuple[int, int, int]]] = [[] for _ in tiers]  # (left, document, start), ascending
    for d, n in enumerate(lengths):
        full = n // top * top
        windows.extend([(d, at, top)] for at in range(0, full, top))
        if n > full:
            pools[_tier(n - full, tiers)].append((n - full, d, full))
    for p in pools:
        p.sort()
    for t, size in enumerate(tiers):
        pool = pools[t]
        while pool:
            n, d, start = pool.pop()
            window, gap = [(d, start, n)], size - n
            while gap:
                filler = None
                for shorter in range(_tier(gap, tiers), len(tiers)):  # whole documents, longest that fits
                    i = bisect_right(pools[shorter], (gap, len(lengths), 0)) - 1
                    if i >= 0:
                        filler = pools[shorter].pop(i)
                        break
                if filler is None:  # none fits: the front of the shortest one that is left
                    source = next((p for p in reversed(pools[t:]) if p), None)
                    if source is None:
                        break
                    n, d, start = source.pop(0)
                    window.append((d, start, gap))
                    insort(pools[_tier(n - gap, tiers)], (n - gap, d, start + gap))
                    gap = 0
                else:
                    n, d, start = filler
                    window.append((d, start, n))
                    gap -= n
            windows.extend([window] if not gap else _powers(window))
    return windows


def _tier(n: int, tiers: tuple[int, ...]) -> int:
    """The smallest tier that holds n."""
    return max(t for t, size in enumerate(tiers) if size >= n)


def _powers(window: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """A window that nothing fills, cut into windows of descending powers of two."""
    left, out = sum(n for _, _, n in window), []
    pieces = window[::-1]
    while left:
        size = 1 << (left.bit_length() - 1)
        left -= size
        out.append([])
        while size:
            d, start, n = pieces.pop()
            take = min(n, size)
            out[-1].append((d, start, take))
            size -= take
            if n > take:
                pieces.append((d, start + take, n - take))
    return out


def step_groups(sizes: list[int], step_tokens: int = STEP_TOKENS) -> list[int]:
    """A step group for each window: largest windows first, each to the group with the fewest tokens."""
    groups = [(0, g) for g in range(max(1, round(sum(sizes) / step_tokens)))]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        tokens, g = groups[0]
        out[i] = g
        heapq.heapreplace(groups, (tokens + sizes[i], g))
    return out


SCHEMA = pa.schema([(n, pa.int64()) for n in ("key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group")] + [("ids", pa.binary())])


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = 2, tiers: tuple[int, ...] = TIERS, keep_ids: bool = True) -> DataFrame:
    """Pack all documents into windows of at most tiers[0] tokens; one row for each piece.

    A document is its ids, then end_id. Returns key, start, length, ids_crc32, doc_tokens,
    sequence_id, offset (gapless from 0 in each sequence), tier (the window's size),
    step_group and, with keep_ids, ids (little-endian unsigned 32-bit). Null and empty texts
    are one end_id. Repeated keys are packed as separate documents; an empty table gives no
    rows; other columns are not read. Tiers descend and are powers of two.
    """
    end = np.asarray([end_id], "<u4").tobytes()

    @tidy
    def pack(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_bpe(tokenizer_path(tokenizer)).ids_bytes
        part = TaskContext.get().partitionId()
        keys, bodies, held, sequence, group = [], [], 0, part << 40, part << 40

        def flush() -> pa.RecordBatch:
            nonlocal sequence, group
            windows = plan_windows([len(b) // 4 for b in bodies], tiers)
            sizes = [sum(n for _, _, n in w) for w in windows]
            groups = step_groups(sizes)
            cols: list[list] = [[] for _ in SCHEMA]
            for w, size, g in zip(windows, sizes, groups, strict=True):
                at = 0
                for d, start, n in w:
                    ids = bodies[d][4 * start : 4 * (start + n)]
                    for c, v in zip(cols, (keys[d], start, n, zlib.crc32(ids), len(bodies[d]) // 4, sequence, at, size, group + g, ids if keep_ids else None), strict=True):
                        c.append(v)
                    at += n
                sequence += 1
            group += max(groups, default=-1) + 1
            keys.clear(), bodies.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, SCHEMA, strict=True)], schema=SCHEMA)

        for batch in rows:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body = ids_of(x.as_py() or "") + end
                keys.append(k), bodies.append(body)
                held += len(body) // 4
                if held >= BLOCK_TOKENS:
                    held = 0
                    yield flush()
        yield flush()

    out = "key bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, tier bigint, step_group bigint, ids binary"
    packed = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(pack, out).withColumnRenamed("key", key)
    return packed if keep_ids else packed.drop("ids")
