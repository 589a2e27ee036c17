"""Lemma distances of all pairs of documents of a block, and of neighbours by id, without a table of these pairs.

A question is weighted once, however many pairs it is in; how often a word occurs over all pairs follows from the number
of pairs of each question. Blocks are cut into cells, and a unit of work is two cells, which gives the pairs between them:
the pairs grow with the square of a block, but a unit is bounded and units are dealt over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions.text import q_text
from pairloom.operators import paradigms
from pairloom.operators.vector_features import lemmas
from pairloom.sources.pairs import ID_STEP
from pairloom.sources.tables import shared_table, tasks

#: Questions of a cell, about; terms whose counts are multiplied at a time.
CELL, TERMS = 1000, 2048
KINDS = ("tfidf_cosine", "tfidf_l2_euclidean", "tf_l2_euclidean")


def with_pair_counts(questions: DataFrame) -> DataFrame:
    """questions (doc_id, question, blk) as a written table, with the size of the block, a number of the row, and in how many pairs it is.

    A question meets all others of its block, and those of the neighbouring ids that are in another block. Without a block (null) it has neighbours only.
    """
    rows = shared_table(questions.withColumn("row", F.monotonically_increasing_id()), "questions")
    a, b = (rows.select(F.col("row").alias(f"row{i}"), F.col("blk").alias(f"blk{i}"), (F.col("doc_id") + 2 - i).alias("at")) for i in (1, 2))
    met = a.join(b, "at").filter(F.coalesce(F.col("blk1") != F.col("blk2"), F.lit(True)))
    beside = met.select(F.explode(F.array("row1", "row2")).alias("row")).groupBy("row").agg(F.count(F.lit(1)).alias("beside"))
    sizes = rows.filter("blk is not null").groupBy("blk").agg(F.count(F.lit(1)).alias("size"))
    out = rows.join(sizes, "blk", "left").join(beside, "row", "left")
    return shared_table(out.select("row", "doc_id", "question", "blk", F.coalesce("size", F.lit(0)).alias("size"), (F.coalesce(F.col("size") - 1, F.lit(0)) + F.coalesce("beside", F.lit(0))).alias("pairs")).filter("pairs > 0"), "counted")


def weighted(counted: DataFrame) -> DataFrame:
    """counted with ids, tf and idf of the learned lemmas of each question: number of the lemma, its count, its weight over all pairs."""
    words = counted.select("row", "pairs", F.explode(lemmas(q_text("question", ""))).alias("word"))
    known = shared_table(words.groupBy("word").agg(F.sum("pairs").alias("n")), "word_counts")
    found = shared_table(paradigms.lemma_table(known, paradigms.mined(known)), "lemmas")
    counts = shared_table(words.join(found, "word").groupBy("row", "pairs", "lemma").agg(F.count(F.lit(1)).alias("tf")), "lemma_counts")
    n = counted.agg(F.sum("pairs").alias("n"))  # one row
    df = counts.groupBy("lemma").agg(F.sum("pairs").alias("df")).crossJoin(F.broadcast(n))
    idf = shared_table(df.select("lemma", F.monotonically_increasing_id().alias("id"), (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1).alias("idf")), "lemma_weights")
    lists = counts.join(idf, "lemma").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("id", F.col("tf").cast("double").alias("tf"), "idf"))).alias("x"))
    none = lambda c, t: F.coalesce(c, F.array().cast(f"array<{t}>"))
    out = counted.join(lists, "row", "left").select("doc_id", "blk", "size", none(F.col("x.id"), "long").alias("ids"), none(F.col("x.tf"), "double").alias("tf"), none(F.col("x.idf"), "double").alias("idf"))
    return shared_table(out, "weighted")


def units(questions: DataFrame, cell: int = CELL) -> DataFrame:
    """questions once for each unit of work (kind, key, low, high) they are in, with their own cell or range as own.

    kind 0: the pairs inside small blocks, many blocks a unit; 1: two cells of a large block; 2: neighbours by id, many ranges a unit.
    """
    parts = max(tasks(questions.sparkSession), -(-questions.count() // cell))
    cells = F.ceil(F.col("size") / cell).cast("int")
    mine = F.pmod(F.xxhash64("doc_id"), cells).cast("int")
    columns = ["doc_id", "blk", "ids", "tf", "idf"]
    key = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)).cast("string")
    zero, none = F.lit(0).cast("int"), F.lit(0).cast("long")
    small = questions.filter(f"size between 2 and {cell}").select(zero.alias("kind"), key("blk").alias("key"), zero.alias("low"), zero.alias("high"), none.alias("own"), *columns)
    big = questions.filter(f"size > {cell}").withColumns({"own": mine, "cells": cells})
    two = F.explode(F.transform(F.sequence(zero, F.col("cells") - 1), lambda c: F.struct(F.least(c, "own").alias("low"), F.greatest(c, "own").alias("high"))))
    large = big.select(*columns, "own", two.alias("u")).select(F.lit(1).alias("kind"), F.col("blk").alias("key"), "u.low", "u.high", F.col("own").cast("long").alias("own"), *columns)
    place = F.floor(F.col("doc_id") / cell)
    ranges = F.explode(F.when(F.pmod("doc_id", F.lit(cell)) == 0, F.array(place, place - 1)).otherwise(F.array(place)))
    beside = questions.select(*columns, ranges.alias("own")).select(F.lit(2).alias("kind"), key("own").alias("key"), zero.alias("low"), zero.alias("high"), "own", *columns)
    return small.union(large).union(beside)


def _over(v: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.divide(v, d, out=np.zeros(np.shape(v)), where=d > 0)


def _lists(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, tf, idf) of all terms of the rows, row by row."""
    lists = group.column("ids").combine_chunks()
    row = np.repeat(np.arange(group.num_rows), lists.value_lengths().to_numpy())
    return row, *(group.column(c).combine_chunks().flatten().to_numpy() for c in ("ids", "tf", "idf"))


def _dots(row: np.ndarray, ids: np.ndarray, tf: np.ndarray, idf: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Products of the counts, with and without idf, of all rows in a with all in b; only terms of both sides are multiplied."""
    at = np.full(row.max(initial=-1) + 2, -1), np.full(row.max(initial=-1) + 2, -1)
    for place, rows in zip(at, (a, b), strict=True):
        kept = rows < len(place)
        place[rows[kept]] = np.flatnonzero(kept)
    here = [np.flatnonzero(place[row] >= 0) for place in at]
    shared, out = np.intersect1d(*(ids[h] for h in here)), [np.zeros((len(a), len(b))) for _ in range(2)]
    for low in range(0, len(shared), TERMS):
        terms = shared[low : low + TERMS]
        x = []
        for place, h, rows in zip(at, here, (a, b), strict=True):
            t = np.minimum(np.searchsorted(terms, ids[h]), len(terms) - 1)
            h, t = h[terms[t] == ids[h]], t[terms[t] == ids[h]]
            plain, heavy = np.zeros((len(rows), len(terms))), np.zeros((len(rows), len(terms)))
            plain[place[row[h]], t], heavy[place[row[h]], t] = tf[h], tf[h] * idf[h]
            x.append((heavy, plain))
        for k in range(2):
            out[k] += x[0][k] @ x[1][k].T
    return out[0], out[1]


def _apart(dots: tuple[np.ndarray, np.ndarray], s1: np.ndarray, s2: np.ndarray) -> list[np.ndarray]:
    """KINDS from products and squared lengths (rows: with and without idf) of either side."""
    cross = [_over(d, np.sqrt(x) * np.sqrt(y)) for d, x, y in zip(dots, s1, s2, strict=True)]
    both = (s1[0] > 0) & (s2[0] > 0)
    far = [np.sqrt(np.maximum((x > 0) * 1.0 + (y > 0) * 1.0 - 2 * c, 0.0)) for c, x, y in zip(cross, s1, s2, strict=True)]
    return [np.where(both, 1 - cross[0], 0.0), far[0], far[1]]


def measured(group: pa.Table, prefix: str = "lemma") -> pa.Table:
    """(pair_id, KINDS) of the pairs of a unit."""
    kind, low, high = (group.column(c)[0].as_py() for c in ("kind", "low", "high"))
    doc, own = group.column("doc_id").to_numpy(), group.column("own").to_numpy()
    row, ids, tf, idf = _lists(group)
    sizes = np.stack([np.bincount(row, x * x, group.num_rows) for x in (tf * idf, tf)])
    _, block = np.unique(np.array(group.column("blk").fill_null("").to_pylist(), object), return_inverse=True)
    null = group.column("blk").is_null().to_numpy()
    found: list[tuple] = []

    def rectangle(a: np.ndarray, b: np.ndarray, of: tuple, inside: bool) -> None:
        far = _apart(_dots(*of, a, b), sizes[:, a][:, :, None], sizes[:, b][:, None, :])
        i, j = np.triu_indices(len(a), 1) if inside else (x.ravel() for x in np.indices((len(a), len(b))))
        found.append((doc[a[i]], doc[b[j]], *(x[i, j] for x in far)))

    def beside() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        order = np.lexsort((doc, own))
        for r in np.split(order, np.flatnonzero(np.diff(own[order])) + 1):
            first, last = (np.searchsorted(doc[r], doc[r] + 1, side) for side in ("left", "right"))
            i = np.repeat(r, last - first)
            j = r[np.repeat(first, last - first) + np.arange(len(i)) - np.repeat(np.cumsum(last - first) - (last - first), last - first)]
            other = (block[i] != block[j]) | null[i] | null[j]
            yield i[other], j[other]

    if kind == 1:
        rectangle(*(np.flatnonzero(own == c) for c in (low, high)), (row, ids, tf, idf), low == high)
    elif kind == 0:
        order, ends = np.argsort(block[row], kind="stable"), np.cumsum(np.bincount(block[row], minlength=block.max() + 1))
        for k, rows in enumerate(np.split(np.argsort(block, kind="stable"), np.cumsum(np.bincount(block))[:-1])):
            terms = order[ends[k - 1] if k else 0 : ends[k]]
            rectangle(rows, rows, (row[terms], ids[terms], tf[terms], idf[terms]), True)
    else:
        pairs = list(beside())
        i, j = (np.concatenate([p[k] for p in pairs]) for k in range(2))
        starts = np.searchsorted(row, np.arange(group.num_rows + 1))
        dots = np.zeros((2, len(i)))
        for k, (x, y) in enumerate(zip(i, j, strict=True)):
            x, y = slice(starts[x], starts[x + 1]), slice(starts[y], starts[y + 1])
            _, p, q = np.intersect1d(ids[x], ids[y], assume_unique=True, return_indices=True)
            both = tf[x][p] * tf[y][q]
            dots[:, k] = (both * idf[x][p] ** 2).sum(), both.sum()
        found.append((doc[i], doc[j], *_apart((dots[0], dots[1]), sizes[:, i], sizes[:, j])))
    one, two, *far = (np.concatenate(x) for x in zip(*found, strict=True))
    return pa.table([np.minimum(one, two) * ID_STEP + np.maximum(one, two), *far], names=["pair_id", *[f"{prefix}_{k}" for k in KINDS]])


def lemma_distances(questions: DataFrame, prefix: str = "lemma", cell: int = CELL) -> DataFrame:
    """(pair_id, distances): vector_features.learned_lemma_distance_features of all pairs of questions (doc_id, question, blk) in a block and all neighbours."""
    work = units(weighted(with_pair_counts(questions)), cell)
    keys = ["kind", "key", "low", "high"]
    dealt = work.repartition(tasks(work.sparkSession), *keys)  # few bytes and dear rows: tasks that are not joined by size
    return dealt.groupBy(*keys).applyInArrow(lambda group: measured(group, prefix), ", ".join(["pair_id bigint", *[f"`{prefix}_{k}` double" for k in KINDS]]))
