"""From shared signature keys to verified connected components, without listing the pairs of a bucket.

star_edges: items that share a key are tied to one item of their bucket, first inside each
task and then once a key, so a bucket costs as many rows as it has members and a hot key at
most one row a task in the shuffle. connected: components of the ties ("families"); items
that can be linked are always in one family. family_links: inside a family every pair is
decided by an exact test on payloads. Large families first meet a few of their own members;
what these tie into one component needs no test inside it, so only the rest meets everything,
in square blocks of bounded size. Links come back as spanning forests.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import discard, materialize, tidy

#: Rows that a task combines at a time, and members of one side of a block of pairs.
COMBINE_ROWS, BLOCK = 400_000, 1024
#: Members of a large family that all its members meet first.
PIVOTS = 48
#: Edges that one task may hold.
TASK_EDGES = 2_000_000
#: (key, item, role) rows of a batch of input; role 0 indexes a key, role 1 only probes it.
Signer = Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]


def _buckets(key: np.ndarray, item: np.ndarray, role: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows in key order, distinct by (key, item): key, item, role, start flags. Indexed rows come first."""
    order = np.lexsort((item, role, key))
    key, item, role = key[order], item[order], role[order]
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    return key, item, role, first


def _stars(key: np.ndarray, item: np.ndarray, role: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ties (a, b), and the rows that must still meet those of other tasks (key, item, role).

    role 0 indexes a key, role 1 only probes it: two probing items need no test. A bucket
    with an indexing item is reduced to it; one without keeps all its rows.
    """
    key, item, role, first = _buckets(key, item, role)
    bucket = np.cumsum(first) - 1
    pivot, pivot_role = item[first][bucket], role[first][bucket]
    indexed = pivot_role == 0
    tie = indexed & (item != pivot)
    rest = np.where(indexed, first, True)
    return pivot[tie], item[tie], key[rest], item[rest], role[rest]


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(a):
        return a, b
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def _longs(*columns: np.ndarray | pa.Array, names: str = "key a b") -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], names=names.split())


def _combine(sign: Signer):
    """Map side: rows (key, item, role) of one block at a time to ties (key, a, b) and one row (key, item, null) a key.

    The lowest bit of the key is the role of the row, so that a row is three numbers.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            a, b, key, item, role = _stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            for at in range(0, len(key), 50_000):
                part = slice(at, at + 50_000)
                yield _longs(key[part] & ~1 | role[part], item[part], pa.nulls(len(key[part]), pa.int64()))
            a, b = _distinct(a, b)
            # a tie travels under its own key, to be spread evenly
            yield _longs(a ^ (b * np.int64(-7046029254386353131)), a, b)

        for key, item, role in sign(it):
            held.append((key & ~1, item, role))
            size += len(key)
            if size >= COMBINE_ROWS:
                yield from flush()
                size = 0
        if held:
            yield from flush()

    return tidy(run)


def _reduce(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduce side: rows come sorted by key (the role's bit aside), so a block of whole keys is held at a time."""
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def flush(whole: bool) -> Iterator[pa.RecordBatch]:
        nonlocal size
        key, item = (np.concatenate(x) for x in zip(*rows, strict=True))
        rows.clear()
        cut = len(key) if whole else int(np.searchsorted(key >> 1, key[-1] >> 1))
        if cut < len(key):  # the last key may go on
            rows.append((key[cut:], item[cut:]))
        size = len(key) - cut
        if cut:
            key, item = key[:cut], item[:cut]
            a, b, *_ = _stars(key >> 1, item, (key & 1).astype(np.int8))
            yield _longs(*_distinct(a, b), names="a b")

    for batch in it:
        b = batch.column(2)
        tie = np.asarray(b.is_valid())
        key, a = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if tie.any():
            yield _longs(a[tie], b.drop_null(), names="a b")
        if not tie.all():
            rows.append((key[~tie], a[~tie]))
            size += len(rows[-1][0])
            if size >= COMBINE_ROWS:
                yield from flush(False)
    if rows:
        yield from flush(True)


def star_edges(rows: DataFrame, sign: Signer, partitions: int) -> DataFrame:
    """Distinct ties (a, b) of the items that sign() gives a common key that one of them indexes."""
    combined = rows.mapInArrow(_combine(sign), "key bigint, a bigint, b bigint")
    place = F.shiftright("key", 1)
    return combined.repartition(partitions, place).sortWithinPartitions("key").mapInArrow(tidy(_reduce), "a bigint, b bigint").distinct()


def smallest_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Items of the edges and, for each, the smallest item of its component."""
    items, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(items))
    while True:
        before = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        np.minimum.at(label, before, label)  # the old root learns of the new one
        while not np.array_equal(jumped := label[label], label):
            label = jumped
        if np.array_equal(before, label):
            return items, items[label]


def _contract(task_edges: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Up to task_edges edges of a task at a time to (item, smallest item of its component among them)."""
        got: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            items, label = smallest_labels(*(np.concatenate(x) for x in zip(*got, strict=True)))
            got.clear()
            return _longs(items, label, names="a b")

        for x in it:
            if x.num_rows:
                got.append((x.column(0).to_numpy(), x.column(1).to_numpy()))
                size += x.num_rows
            if size >= task_edges:
                yield flush()
                size = 0
        if got:
            yield flush()

    return tidy(run)


def connected(edges: DataFrame, label: str = "component", task_edges: int = TASK_EDGES) -> DataFrame:
    """(item, component) of every item in the edges (a, b); the component is its smallest item.

    Edges are first contracted to stars, block by block in each task. As soon as they fit one
    bounded task (task_edges) it finishes them; a larger graph goes on with distributed rounds:
    smallest labels of neighbours, then of the label's own item, until nothing changes. Every
    step is a table in the shared folder.
    """
    held = materialize(edges.select("a", "b"), "edges")
    size = held.count()
    if size > task_edges:
        parts = -(-size // task_edges) * 2
        stars = materialize(held.repartition(parts, "a").mapInArrow(_contract(task_edges), "a bigint, b bigint"), "edges")
        discard(held)
        held, size = stars, stars.count()
    if size <= task_edges:
        return held.coalesce(1).mapInArrow(_contract(task_edges + 1), "a bigint, b bigint").select(F.col("a").alias("item"), F.col("b").alias(label))
    return _rounds(held, label)


def _rounds(edges: DataFrame, label: str) -> DataFrame:
    both = materialize(edges.union(edges.select(F.col("b"), F.col("a"))), "edges")
    labels = materialize(both.groupBy("a").agg(F.min(F.least("a", "b")).alias("c")).select(F.col("a").alias("item"), "c"), "labels")
    while True:
        near = both.join(labels.select(F.col("item").alias("b"), "c"), "b").groupBy("a").agg(F.min("c").alias("n"))
        stepped = labels.join(near.withColumnRenamed("a", "item"), "item").select("item", "c", F.least("c", "n").alias("n"))
        jump = labels.select(F.col("item").alias("n"), F.col("c").alias("j"))
        after = materialize(stepped.join(jump, "n").select("item", F.least("n", "j").alias("c"), (F.least("n", "j") < F.col("c")).alias("moved")), "labels")
        moved = after.filter("moved").limit(1).count()
        discard(labels)
        labels = after.select("item", "c")
        labels._pairloom_path = after._pairloom_path
        if not moved:
            discard(both)
            discard(edges)
            return labels.withColumnRenamed("c", label)


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


Verify = Callable[[pa.Table, "pa.Table | None"], Iterator[tuple[int, int]]]


def family_links(families: DataFrame, payload: DataFrame, verify: Verify, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """Links (a, b) that join every component of the linked pairs of each family.

    families: (item, family), and room, if a family's blocks are to have another size than `block`;
    payload: item and what verify needs. verify(x, y) yields the linked positions of rows of
    x and y (of x and itself if y is None). A family of up to `block` items is one group. In a
    larger one about `pivots` members, chosen by hash, first meet all others; the largest component
    that their links make is settled: pairs inside it need no test. The others are dealt into sides
    of about `block` items and each of their sides meets every side of the family, so copies of a
    member are as many as the sides of the others.
    """
    spark = families.sparkSession
    if "room" not in families.columns:
        families = families.withColumn("room", F.lit(block))
    sizes = materialize(families.groupBy("family").agg(F.count(F.lit(1)).alias("members"), F.max("room").alias("room")).filter("members > 1"), "sizes")
    families = families.drop("room")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if not sizes.filter("members > room").limit(1).count():
        whole = families.join(sizes, "family").select("item", "family", F.lit(0).alias("low"), F.lit(0).alias("high"), F.lit(0).alias("side"))
        return _decide(whole, payload, verify, parts)
    held = materialize(families.join(sizes, "family"), "members")
    large = held.filter("members > room").withColumn("dealt", F.ceil(F.col("members") / F.col("room")).cast("int"))
    # side 0 are the pivots, the others the deals
    uniform = F.pmod(F.xxhash64("item", F.lit("pivot")), F.lit(1 << 30)) / float(1 << 30)
    first = large.filter(uniform < pivots / F.col("members")).withColumn("high", F.explode(F.sequence(F.lit(1), F.col("dealt")))).withColumn("side", F.lit(0))
    deal = large.withColumn("high", (1 + F.pmod(F.xxhash64("item"), F.col("dealt"))).cast("int")).withColumn("side", F.col("high"))
    met = first.select("item", "family", F.lit(0).alias("low"), "high", "side").union(deal.select("item", "family", F.lit(0).alias("low"), "high", "side"))
    links = materialize(_decide(met, payload, verify, parts), "links")
    # the component of a family that most of its members are in
    joined = large.join(connected(links, "tree"), "item", "left")
    trees = joined.filter("tree is not null").groupBy("family", "tree").agg(F.count(F.lit(1)).alias("n")).groupBy("family").agg(F.max(F.struct("n", "tree")).alias("most"))
    known = materialize(joined.join(trees.select("family", F.col("most.tree").alias("settled")), "family", "left").select("item", "family", "room", F.coalesce(F.col("tree") == F.col("settled"), F.lit(False)).alias("done")), "known")
    sides = lambda done: F.ceil(F.coalesce(F.sum((F.col("done") == done).cast("int")), F.lit(0)) / F.max("room")).cast("int")
    counted = known.groupBy("family").agg(sides(False).alias("open"), sides(True).alias("closed")).filter("open > 0")
    # sides 0 .. open - 1 are the others, the settled ones follow
    sided = known.join(counted, "family").withColumn("side", F.when(F.col("done"), F.col("open") + F.pmod(F.xxhash64("item"), F.col("closed"))).otherwise(F.pmod(F.xxhash64("item"), F.col("open"))).cast("int"))
    other = F.when(F.col("done"), F.sequence(F.lit(0), F.col("open") - 1)).otherwise(F.sequence(F.lit(0), F.col("open") + F.col("closed") - 1))
    crossed = sided.withColumn("other", F.explode(other)).select("item", "family", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side")
    small = held.filter("members <= room").select("item", "family", F.lit(0).alias("low"), F.lit(0).alias("high"), F.lit(0).alias("side"))
    return links.union(_decide(small.union(crossed), payload, verify, parts))


def _decide(sided: DataFrame, payload: DataFrame, verify: Verify, parts: int) -> DataFrame:
    """Links of the groups (family, low, high): rows of side low meet those of side high, or each other if the two are one."""
    # small families share groups, so that a group's fixed cost is not paid for every pair of items
    chunk = F.when(F.col("high") > 0, F.xxhash64("family", "low", "high")).otherwise(F.pmod(F.xxhash64("family"), F.lit(1 << 40)))
    rows = payload.join(sided, "item").withColumn("cell", chunk)

    def decide(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in cells(it):
            a, b = [], []
            names = ["family", "low", "high", "side", "item"]
            cols = [table[c].to_numpy() for c in names]
            order = np.lexsort(cols[::-1])
            cols = [c[order] for c in cols]
            fresh = np.ones(len(order), bool)  # a repeated row of a side counts once
            fresh[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
            table, cols = table.take(order[fresh]).combine_chunks(), [c[fresh] for c in cols]
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0)) + 1
            _, low, high, side, item = cols
            for start, end in zip([0, *new.tolist()], [*new.tolist(), len(item)], strict=True):
                one = low[start] == high[start]
                n = end - start if one else int(np.searchsorted(side[start:end], high[start]))
                if end - start < 2 or not n or not one and start + n == end:
                    continue
                x, y = table.slice(start, n), None if one else table.slice(start + n, end - start - n)
                left, right = item[start:end], item[start if one else start + n : end]
                forest = Forest(end - start)
                for i, j in verify(x, y):
                    if forest.join(i, j if one else n + j) and left[i] != right[j]:
                        a.append(int(left[i]))
                        b.append(int(right[j]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def cells(it: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Whole cells at a time: rows come sorted by cell."""
        held: list[pa.Table] = []
        last = None
        for batch in it:
            if not batch.num_rows:
                continue
            cell = batch.column(batch.schema.get_field_index("cell")).to_numpy()
            start = 0
            # up to the last change of cell everything is complete
            edge = np.flatnonzero(cell[1:] != cell[:-1]) + 1
            if last is not None and cell[0] != last and held:
                yield pa.Table.from_batches(held)
                held = []
            if len(edge):
                cut = int(edge[-1])
                held.append(batch.slice(0, cut))
                yield pa.Table.from_batches(held)
                held, start = [], cut
            held.append(batch.slice(start))
            last = cell[-1]
        if held:
            yield pa.Table.from_batches(held)

    return rows.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(tidy(decide), "a bigint, b bigint")
