"""Graph features over question pairs. Nodes are question texts; each operator has its own edge rule."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions.text import q_text, split_words, without_stops
from pairloom.operators.lexical import word_match_ratio
from pairloom.sources.tables import numbered, shared_table


def question_ids(pairs: DataFrame) -> DataFrame:
    """(question, qid): every distinct text with the smallest place (pair_id, side) where it stands; nulls are one text."""
    places = pairs.select(F.explode(F.array(F.struct(F.col("question1").alias("question"), (2 * F.col("pair_id")).alias("at")), F.struct(F.col("question2").alias("question"), (2 * F.col("pair_id") + 1).alias("at")))).alias("x"))
    return places.groupBy("x.question").agg(F.min("x.at").alias("qid"))


def dense_ids(pairs: DataFrame) -> DataFrame:
    """(question, qid): ids 0, 1, 2, ... by first appearance (pair_id, then side); null is one text."""
    first = question_ids(pairs).withColumnRenamed("qid", "at")
    return numbered(first, [F.col("at")], "place").select("question", (F.col("place") - 1).alias("qid"))


def frequency(pairs: DataFrame) -> DataFrame:
    """How often either question occurs on either side; nulls count as one question, a self pair twice."""
    counts = pairs.select(F.explode(F.array("question1", "question2")).alias("q")).groupBy("q").agg(F.count(F.lit(1)).alias("n"))
    one, two = counts.select(F.col("q").alias("x1"), F.col("n").alias("q1_freq")), counts.select(F.col("q").alias("x2"), F.col("n").alias("q2_freq"))
    return pairs.join(one, F.col("question1").eqNullSafe(F.col("x1"))).join(two, F.col("question2").eqNullSafe(F.col("x2"))).select("pair_id", "q1_freq", "q2_freq")


def simple_edges(pairs: DataFrame, null_as: str = "", loops: bool = True) -> DataFrame:
    """Distinct symmetric edges (src, dst)."""
    e = pairs.select(q_text("question1", null_as).alias("src"), q_text("question2", null_as).alias("dst"))
    both = e.union(e.select("dst", "src")).distinct()
    return both if loops else both.filter("src <> dst")


def coded(pairs: DataFrame, null_as: str | None = None) -> DataFrame:
    """pairs with a number for each distinct question in place of its text: exact, and far shorter in every later shuffle.

    Numbers are given as texts are written, not by place, so that pairs that repeat a pair_id don't mix questions up. Null texts count as null_as, or stay null.
    """
    texts = pairs if null_as is None else pairs.withColumns({q: q_text(q, null_as) for q in ("question1", "question2")})
    distinct = texts.select(F.explode(F.array("question1", "question2")).alias("question")).distinct().filter("question is not null")
    ids = shared_table(distinct.withColumn("qid", F.monotonically_increasing_id()), "question_ids")
    for i in (1, 2):
        texts = texts.join(ids.select(F.col("question").alias(f"question{i}"), F.col("qid").alias(f"__q{i}")), f"question{i}", "left")
    return shared_table(texts.select(*[F.col(f"__q{c[-1]}").alias(c) if c in ("question1", "question2") else c for c in pairs.columns]), "coded")


def coded_edges(numbers: DataFrame, loops: bool = True) -> DataFrame:
    """Distinct symmetric edges (src, dst) of pairs of coded()."""
    e = numbers.select(F.col("question1").alias("src"), F.col("question2").alias("dst"))
    both = e.union(e.select("dst", "src")).distinct()
    return both if loops else both.filter("src <> dst")


def coded_ends(numbers: DataFrame) -> DataFrame:
    """(pair_id, x, y): the numbers of a pair's questions in order."""
    return numbers.select("pair_id", F.least("question1", "question2").alias("x"), F.greatest("question1", "question2").alias("y"))


#: Neighbours of a node that one task walks; those of a larger node are dealt over several slices.
HUB = 10_000


def walked(asked: DataFrame, edges: DataFrame, hub: int = HUB) -> DataFrame:
    """(x, y, high, n, ...): for each asked pair (x, y), the neighbours n of its end of lower degree; high is its other end.

    edges: symmetric, distinct (src, dst), whose further columns follow n; asked: distinct. A pair of a hub and a
    leaf brings the leaf's neighbours, so the rows are the sum of the lower degrees, which for pairs that
    are edges is linear on stars and at most edges^1.5. Nodes of more than `hub` neighbours are dealt over
    slices, each of which meets the pairs that walk them.
    """
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    end = lambda name, column: degree.select(F.col("src").alias(name), F.struct("degree", "src").alias(column))
    ends = asked.select("x", "y").join(end("x", "dx"), "x").join(end("y", "dy"), "y")
    slices = lambda size: (F.floor((size - 1) / hub) + 1).cast("int")
    low, high = F.least("dx", "dy"), F.greatest("dx", "dy")
    walks = ends.select("x", "y", low["src"].alias("src"), high["src"].alias("high"), F.explode(F.sequence(F.lit(0), slices(low["degree"]) - 1)).alias("slice"))
    dealt = edges.join(degree, "src").withColumn("slice", F.pmod(F.xxhash64("dst"), slices(F.col("degree"))).cast("int")).withColumnRenamed("dst", "n").drop("degree")
    return walks.join(dealt, ["src", "slice"]).drop("src", "slice")


def common_neighbours(pairs: DataFrame) -> DataFrame:
    """Number of shared neighbours, and their share of edge weight (word match ratio), on the simple graph."""
    words = lambda c: F.array_distinct(without_stops(split_words(q_text(c))))
    numbers = coded(pairs.select("pair_id", "question1", "question2", F.col("question1").alias("text1"), F.col("question2").alias("text2")), "nan")
    # an edge is weighted once, however many pairs have it
    ends = numbers.groupBy(F.least("question1", "question2").alias("src"), F.greatest("question1", "question2").alias("dst")).agg(F.first(F.struct("text1", "text2")).alias("texts"))
    one = shared_table(ends, "edge_texts").select("src", "dst", word_match_ratio(words("texts.text1"), words("texts.text2")).alias("w"))
    one = shared_table(one, "weights")
    edges = one.union(one.filter("src <> dst").select("dst", "src", "w"))
    totals = edges.groupBy("src").agg(F.sum("w").alias("total"))
    keyed = coded_ends(numbers)
    second = edges.select(F.col("src").alias("high"), F.col("dst").alias("n"), F.col("w").alias("w2"))
    # the edge weight is symmetric, so it does not matter which end was walked
    sums = walked(keyed.select("x", "y").distinct(), edges).join(second, ["high", "n"]).groupBy("x", "y").agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("w") + F.col("w2")).alias("sw"))
    out = keyed.join(sums, ["x", "y"], "left").join(totals.select(F.col("src").alias("x"), F.col("total").alias("t1")), "x").join(totals.select(F.col("src").alias("y"), F.col("total").alias("t2")), "y")
    return out.select("pair_id", F.coalesce("k", F.lit(0)).alias("q1_q2_intersect"), F.coalesce(F.try_divide("sw", F.col("t1") + F.col("t2")), F.lit(0.0)).alias("q1_q2_wm_ratio"))


def with_ends(pairs: DataFrame, null_as: str = "") -> DataFrame:
    """(pair_id, x, y): the pair's questions in order, so that both directions ask the same."""
    a, b = q_text("question1", null_as), q_text("question2", null_as)
    return pairs.select("pair_id", F.least(a, b).alias("x"), F.greatest(a, b).alias("y"))


def _links(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """coded_links() of pairs of texts."""
    return coded_links(coded(pairs.select("pair_id", "question1", "question2"), ""))


def coded_links(numbers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(src, dst, share of src's rank that flows to dst) of the undirected multigraph, and its nodes."""
    e = numbers.select(F.col("question1").alias("src"), F.col("question2").alias("dst"))
    edges = e.union(e.select("dst", "src")).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("m"))
    degree = edges.groupBy("src").agg(F.sum("m").alias("degree"))
    return shared_table(edges.join(degree, "src").select("src", "dst", (F.col("m") / F.col("degree")).alias("share")), "links"), shared_table(degree.select(F.col("src").alias("node")), "nodes")


def _both_ranks(numbers: DataFrame, ranks: DataFrame) -> DataFrame:
    one, two = ranks.select(F.col("node").alias("question1"), F.col("pr").alias("q1_pr")), ranks.select(F.col("node").alias("question2"), F.col("pr").alias("q2_pr"))
    return numbers.select("pair_id", "question1", "question2").join(one, "question1").join(two, "question2").select("pair_id", "q1_pr", "q2_pr")


def pagerank(pairs: DataFrame, damping: float = 0.85, steps: int = 40, every: int = 8, tol: float | None = None) -> DataFrame:
    """PageRank of both questions on the undirected multigraph, by synchronous steps, or with tol up to an error.

    A step is one join and one pre-aggregated sum; every few steps the ranks are written to the
    shared folder, so plans stay short and a lost executor costs a few steps at most. With tol, the absolute
    errors of all ranks sum up to tol at most (see converged_ranks), and steps is not used.
    """
    numbers = coded(pairs.select("pair_id", "question1", "question2"), "")
    links, nodes = coded_links(numbers)
    if tol is not None:
        return _both_ranks(numbers, converged_ranks(links, nodes, damping, tol)[0])
    n = nodes.count()
    ranks = nodes.withColumn("pr", F.lit(1.0 / max(n, 1)))
    for step in range(1, steps + 1):
        flow = links.join(ranks, links.src == ranks.node).groupBy("dst").agg(F.sum(F.col("pr") * F.col("share")).alias("flow"))
        ranks = flow.select(F.col("dst").alias("node"), ((1 - damping) / max(n, 1) + damping * F.col("flow")).alias("pr"))
        if step % every == 0 and step < steps:
            ranks = shared_table(ranks, "ranks")
    return _both_ranks(numbers, shared_table(ranks, "ranks"))


def converged_ranks(links: DataFrame, nodes: DataFrame, damping: float, tol: float) -> tuple[DataFrame, list[int]]:
    """(node, pr) with a summed error of tol at most, and the number of nodes that sent in each round.

    A node keeps a residual, what has flowed in and was not passed on. Only nodes with more than tol (1 - damping) / nodes
    of it take it into their rank and send it on, so rounds get cheaper; what is left at the end bounds the error.
    """
    n = max(nodes.count(), 1)
    least = tol * (1 - damping) / n
    state, sent = shared_table(nodes.select("node", F.lit(0.0).alias("pr"), F.lit((1 - damping) / n).alias("left")), "ranks"), []
    while True:
        due = F.col("left") > least
        active = state.filter(due)
        sent.append(active.count())
        if not sent[-1]:
            return state.select("node", "pr"), sent
        flow = active.join(links, F.col("node") == F.col("src")).groupBy("dst").agg((damping * F.sum(F.col("left") * F.col("share"))).alias("flow")).withColumnRenamed("dst", "node")
        passed = F.when(due, F.col("left")).otherwise(0.0)
        state = shared_table(state.join(flow, "node", "left").select("node", (F.col("pr") + passed).alias("pr"), (F.col("left") - passed + F.coalesce("flow", F.lit(0.0))).alias("left")), "ranks")


def triangles(pairs: DataFrame) -> DataFrame:
    """Triangles that each pair's edge closes, without self loops."""
    numbers = coded(pairs.select("pair_id", "question1", "question2"), "")
    edges = shared_table(coded_edges(numbers, loops=False), "edges")
    keyed = coded_ends(numbers)
    third = edges.select(F.col("src").alias("high"), F.col("dst").alias("n"))
    hit = walked(keyed.filter("x <> y").select("x", "y").distinct(), edges).join(third, ["high", "n"], "left_semi").groupBy("x", "y").agg(F.count(F.lit(1)).alias("k"))
    return keyed.join(hit, ["x", "y"], "left").select("pair_id", F.coalesce("k", F.lit(0)).alias("triangles"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of an edge table (src, dst): smallest labels with pointer jumps, written each round."""
    both = shared_table(edges.select("src", "dst").union(edges.select("dst", "src")).distinct(), "edges")
    labels = shared_table(both.groupBy("src").agg(F.min("dst").alias("d")).select(F.col("src").alias("node"), F.least("src", "d").alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "dst", "component": "n"}), "dst").groupBy("src").agg(F.min("n").alias("n")).withColumnRenamed("src", "node")
        stepped = labels.join(near, "node").select("node", "component", F.least("component", "n").alias("n"))
        jump = labels.select(F.col("node").alias("n"), F.col("component").alias("j"))
        after = shared_table(stepped.join(jump, "n").select("node", F.least("n", "j").alias("component"), (F.least("n", "j") < F.col("component")).alias("moved")), "labels")
        labels = after.select("node", "component")
        if not after.filter("moved").limit(1).count():
            return labels


def component_sizes(pairs: DataFrame) -> DataFrame:
    """Nodes and edges of each pair's connected subgraph (simple graph with loops kept as nodes)."""
    numbers = coded(pairs.select("pair_id", "question1", "question2"), "")
    edges = shared_table(coded_edges(numbers), "edges")
    found = shared_table(components(edges), "components")
    nodes = found.groupBy("component").agg(F.count(F.lit(1)).alias("subgraph_nodes"))
    inner = edges.filter("src < dst").join(found.withColumnRenamed("node", "src"), "src").groupBy("component").agg(F.count(F.lit(1)).alias("subgraph_edges"))
    keyed = numbers.select("pair_id", F.col("question1").alias("node")).join(found, "node")
    return keyed.join(nodes, "component").join(inner, "component", "left").select("pair_id", "subgraph_nodes", F.coalesce("subgraph_edges", F.lit(0)).alias("subgraph_edges"))


def peeled(edges: DataFrame) -> DataFrame:
    """(node, level) of symmetric, distinct edges without loops: rounds of core peeling.

    A round takes away every node of at most twice the average degree of what is left, which is half of the
    nodes at least; so rounds are logarithmic in the nodes, and a node has at most four times as many
    neighbours of its own level or higher as the densest part of the graph has edges a node.
    """
    live, levels, level = edges.select("src", "dst"), [], 0
    while True:
        degree = shared_table(live.groupBy("src").agg(F.count(F.lit(1)).alias("degree")), "degrees")
        nodes, ends = degree.agg(F.count(F.lit(1)), F.sum("degree")).first()
        if not nodes:
            break
        leaves = F.col("degree") * nodes <= 2 * ends
        levels.append(degree.filter(leaves).select(F.col("src").alias("node"), F.lit(level).alias("level")))
        rest = degree.filter(~leaves).select("src")
        live = shared_table(live.join(rest, "src", "left_semi").join(rest.withColumnRenamed("src", "dst"), "dst", "left_semi").select("src", "dst"), "core")
        level += 1
        # nodes that have lost all their neighbours in this round
        levels.append(rest.join(live, "src", "left_anti").select(F.col("src").alias("node"), F.lit(level).alias("level")))
    empty = edges.select(F.col("src").alias("node"), F.lit(0).alias("level")).limit(0)
    return reduce(DataFrame.union, levels, empty)


def largest_clique(neighbours: list[int], inside: int, floor: int = 0) -> int:
    """A largest clique among the nodes of `inside` if it has more than `floor` nodes, else 0; sets are bits of numbers.

    Branch and bound: nodes are coloured greedily, and a branch ends where colours cannot beat the best clique.
    """
    best, found = floor, 0

    def coloured(free: int) -> list[tuple[int, int]]:
        """Nodes with the number of colours up to theirs, which bounds a clique of them and those before."""
        out, colour = [], 0
        while free:
            colour += 1
            same = free
            while same:
                bit = same & -same
                v = bit.bit_length() - 1
                out.append((v, colour))
                free ^= bit
                same &= ~(neighbours[v] | bit)
        return out

    work = [(inside, 0, 0, coloured(inside))]
    while work:
        free, chosen, size, order = work.pop()
        if not order or size + order[-1][1] <= best:
            continue
        v, _ = order.pop()
        work.append((free & ~(1 << v), chosen, size, order))
        inner = free & neighbours[v]
        if inner:
            work.append((inner, chosen | 1 << v, size + 1, coloured(inner)))
        elif size + 1 > best:
            best, found = size + 1, chosen | 1 << v
    return found


def bits(mask: int) -> Iterator[int]:
    while mask:
        low = mask & -mask
        yield low.bit_length() - 1
        mask ^= low


def edge_cliques(neighbours: list[int]) -> dict[tuple[int, int], int]:
    """Size of the largest clique that holds each edge (i < j) of a graph; a clique settles all its edges at once."""
    sizes = {(i, j): 2 for i, near in enumerate(neighbours) for j in bits(near >> i << i) if j > i}
    for i, j in sizes:
        inside = neighbours[i] & neighbours[j]
        found = largest_clique(neighbours, inside, sizes[i, j] - 2)
        if found:
            members = sorted(bits(found | 1 << i | 1 << j))
            for k, a in enumerate(members):
                for b in members[k + 1 :]:
                    sizes[a, b] = max(sizes[a, b], len(members))
    return sizes


def edges_with_cliques(edges: DataFrame) -> DataFrame:
    """(x, y, size), x < y, of the edges that lie in a triangle: the largest clique that holds them.

    Nodes are ordered by their peeling level. A clique lies in the later neighbours of its first node,
    which are few whatever the degree; the triangles that a node begins give the graph among them, and each node
    is solved by itself, many in a task.
    """
    levels = shared_table(peeled(edges), "levels")
    rank = lambda name: levels.select(F.col("node").alias(name), F.struct("level", F.col("node")).alias(f"{name}_rank"))
    later = shared_table(edges.select("src", "dst").join(rank("src"), "src").join(rank("dst"), "dst").filter("src_rank < dst_rank").select("src", "dst"), "later")
    two = later.select(F.col("src").alias("v"), F.col("dst").alias("n")).join(later.select(F.col("src").alias("n"), F.col("dst").alias("o")), "n")
    begun = two.join(later.select(F.col("src").alias("v"), F.col("dst").alias("o")), ["v", "o"], "left_semi")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(v: str, inner: list[tuple[str, str]]) -> pa.RecordBatch:
            names = sorted({x for e in inner for x in e} | {v})
            at = {x: i for i, x in enumerate(names)}
            near = [0] * len(names)
            for a, b in [*inner, *((v, x) for x in names if x != v)]:
                near[at[a]] |= 1 << at[b]
                near[at[b]] |= 1 << at[a]
            found = edge_cliques(near)
            return pa.RecordBatch.from_pydict({"x": [names[i] for i, _ in found], "y": [names[j] for _, j in found], "size": list(found.values())}, schema=pa.schema([("x", pa.string()), ("y", pa.string()), ("size", pa.int64())]))

        open_node, inner = None, []
        for batch in batches:
            for v, n, o in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if v != open_node and inner:
                    yield solved(open_node, inner)
                    inner = []
                open_node = v
                inner.append((n, o))
        if inner:
            yield solved(open_node, inner)

    solved = begun.select("v", "n", "o").repartition("v").sortWithinPartitions("v").mapInArrow(solve, "x string, y string, size long")
    return solved.groupBy("x", "y").agg(F.max("size").alias("size"))


def clique_size(pairs: DataFrame) -> DataFrame:
    """Size of the largest clique that holds the pair's edge; -1 for a self pair."""
    edges = shared_table(simple_edges(pairs, "", loops=False), "edges")
    out = with_ends(pairs).join(edges_with_cliques(edges), ["x", "y"], "left")
    return out.select("pair_id", F.when(F.col("x") == F.col("y"), -1).otherwise(F.coalesce("size", F.lit(2))).cast("long").alias("clique_size"))


def small_cliques(pairs: DataFrame) -> DataFrame:
    """clique_size up to 4: whether the pair's edge lies in a triangle, and in two that share a further edge."""
    return clique_size(pairs).select("pair_id", F.least("clique_size", F.lit(4)).cast("long").alias("clique_to_4"))
