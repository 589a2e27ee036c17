"""Source divergence audit: how far the term shares of a source lie from those of the other sources of its language.

Sort-based streaming in two sweeps. Rows are sorted by (lang, term, source, document) inside bounded
buffers and scanned run by run, which gives document frequency and occurrences of each (lang, term,
source); these partial runs are repartitioned by (lang, term), sorted, and scanned again, so that a
term in a third of all documents sends one row a buffer and source, not one a document. Kept terms
are then sorted by blocks of sources and scanned a second time; each sweep sums the terms of the runs
that it has met, and emits partial pairs and the best terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.common import materialize, tidy
from pairloom.llm.words import Numbers, byte_table, slices, utf8

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: Terms are ASCII letters and everything beyond ASCII.
TERMS = byte_table(LETTERS, "".join(chr(c) for c in range(128) if chr(c) not in LETTERS))
# A term is kept where at least so many documents of its language hold it; of a group's terms so many are returned.
MIN_DOCS, TOP_TERMS = 10, 10
#: Words in a buffer (a longer document is a buffer by itself), and kept rows in a slice of the second sweep.
BUFFER, SLICE_ROWS = 2_000_000, 200_000
#: Sources whose pairs a sweep sums at once: 256 x 256 sums of 8 bytes.
BLOCK = 256
#: Pairs of sources times terms that are computed at once.
CELLS = 2_000_000
SHARE = 1_000_000_000

RUNS = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("docs", pa.int64()), ("n", pa.int64())])
TOTALS = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("whole", pa.bool_()), ("n", pa.int64())])
FOUND = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def starts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    changed = np.ones(len(columns[0]), bool)
    changed[1:] = False
    for c in columns:
        changed[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(changed)


def changes(column: pa.Array) -> np.ndarray:
    """A number for each row that grows where the value differs from that of the row before."""
    if len(column) < 2:
        return np.zeros(len(column), np.int64)
    return np.concatenate([[0], np.cumsum(pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False))])


def document_runs(docs: DataFrame) -> DataFrame:
    """(lang, term, source, docs, n) of docs(lang, source, body): runs of rows sorted inside bounded buffers."""

    @tidy
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, groups, parts, of, held = Numbers(), Numbers(), [], [], 0

        def runs() -> pa.RecordBatch:
            group = np.asarray(of, np.int64)
            place = np.empty(len(of), np.int64)  # documents by group, so that one number orders source and document
            place[np.argsort(group, kind="stable")] = np.arange(len(of))
            at = np.repeat(place, [len(p) for p in parts])
            rows = np.sort(np.concatenate(parts) * len(of) + at)
            by_group = np.empty(len(of), np.int64)
            by_group[place] = group
            term, document = np.divmod(rows, len(of))
            first = starts(rows)  # one a term and document
            term, source, size = term[first], by_group[document[first]], np.diff(first, append=len(rows))
            run = starts(term, source)
            langs, sources = (pa.array([g[i] for g in groups], pa.string()) for i in (0, 1))
            ids = pa.array(source[run])
            return pa.RecordBatch.from_arrays([langs.take(ids), utf8(pa.array(list(terms), pa.binary())).take(pa.array(term[run])), sources.take(ids), pa.array(np.diff(run, append=len(term))), pa.array(np.add.reduceat(size, run))], schema=RUNS)

        for batch in batches:
            for lang, source, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                number = groups[lang, source]
                words = [np.fromiter(map(terms.__getitem__, w), np.int64, len(w)) for part in slices(body.as_py().translate(TERMS)) if (w := part.split())]
                if not words:
                    continue
                parts.append(np.concatenate(words))
                of.append(number)
                held += len(parts[-1])
                if held >= BUFFER:
                    yield runs()
                    terms, groups, parts, of, held = Numbers(), Numbers(), [], [], 0
        if held:
            yield runs()

    return docs.select("lang", "source", "body").mapInArrow(scan, "lang string, term string, source string, docs bigint, n bigint")


def kept_terms(runs: DataFrame, min_docs: int) -> DataFrame:
    """(lang, term, source, whole, n) of terms in at least min_docs documents of the lang; whole: all sources, with source ''.

    Streams over rows sorted by (lang, term, source). Of the term that a batch leaves open, the rows
    are held until min_docs documents are met, which are min_docs rows at most, and go out from then on.
    """

    @tidy
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, met, sent = None, 0, 0  # rows of the open term; its documents and occurrences in rows that went out already

        def sources(rows: pa.Table, lead_docs: int, lead_n: int, last: bool) -> tuple[pa.RecordBatch, pa.Table | None, int, int]:
            """Totals of the finished terms in rows; the open term's rows, and what of it went out."""
            lang, name, source = (rows.column(c).combine_chunks() for c in ("lang", "term", "source"))
            docs, n = rows.column("docs").to_numpy(), rows.column("n").to_numpy()
            term_at = changes(lang) + changes(name)
            run = starts(term_at, changes(source))
            docs, n, head = np.add.reduceat(docs, run), np.add.reduceat(n, run), term_at[run]
            first = starts(head)
            all_docs, all_n = np.add.reduceat(docs, first), np.add.reduceat(n, first)
            all_docs[0] += lead_docs
            all_n[0] += lead_n
            size = np.diff(first, append=len(head))
            good = all_docs >= min_docs
            done = len(first) - (not last)
            row_ok = np.repeat(good, size)
            open_docs = open_n = 0
            left = None
            if not last:
                at = first[-1]
                if good[-1]:  # all rows of it but the newest source's may go
                    at = len(run) - 1
                    open_docs, open_n = int(all_docs[-1] - docs[-1]), int(all_n[-1] - n[-1])
                row_ok[at:] = False
                left = rows.take(pa.array(run[at:]))
                left = left.set_column(3, "docs", pa.array(docs[at:])).set_column(4, "n", pa.array(n[at:]))
            rows_out, whole_out = run[row_ok], first[:done][good[:done]]
            ids = pa.array(np.concatenate([rows_out, run[whole_out]]))
            blank = pa.array([""] * len(whole_out), pa.string())
            out = pa.RecordBatch.from_arrays([lang.take(ids), name.take(ids), pa.concat_arrays([source.take(pa.array(rows_out)), blank]), pa.array(np.repeat([False, True], [len(rows_out), len(whole_out)])), pa.array(np.concatenate([n[row_ok], all_n[:done][good[:done]]]))], schema=TOTALS)
            return out, left, open_docs, open_n

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch], schema=RUNS)
            if rest is not None:
                rows = pa.concat_tables([rest, rows])
            out, rest, met, sent = sources(rows, met, sent, False)
            yield out
        if rest is not None:
            yield sources(rest, met, sent, True)[0]

    sorted_runs = runs.repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    return sorted_runs.mapInArrow(scan, "lang string, term string, source string, whole boolean, n bigint")


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p-q)^2 / (p+q)); both are at most 1 + SHARE, so that squares stay below 2^63."""
    return (p - q) ** 2 // (p + q)


class Sweep:
    """Sums and best terms of one (lang, rows' block, columns' block, slice) while its terms stream by."""

    def __init__(self, key: tuple, top: int):
        self.key, self.top, self.names, self.base, self.block = key, top, [], [], []
        self.at: dict[str, int] | None = None
        self.best: tuple[np.ndarray, np.ndarray, list] = (np.empty(0, np.int64), np.empty(0, np.int64), [])

    def head(self, names: list[str], base: list[int], block: list[int]) -> None:
        self.names += names
        self.base += base
        self.block += block

    def begin(self) -> None:
        self.at = {s: i for i, s in enumerate(self.names)}
        self.zero, block = np.asarray(self.base, np.int64), np.asarray(self.block)
        self.rows, self.columns = np.flatnonzero(block == self.key[1]), np.flatnonzero(block == self.key[2])
        self.sums = np.zeros((len(self.rows), len(self.columns)), np.int64)

    def terms(self, number: np.ndarray, name: pa.Array, whole: np.ndarray, source: list[str], p: np.ndarray) -> None:
        """Rows of whole terms, numbered from 0."""
        count = int(number[-1]) + 1
        where = np.fromiter((self.at[s] for s in np.asarray(source, object)[~whole]), np.int64, int((~whole).sum()))
        step = max(1, CELLS // max(1, self.sums.size))
        mine, share = number[~whole], p[~whole]
        for k in range(0, count, step):
            table = np.tile(self.zero, (min(step, count - k), 1))
            at = slice(*np.searchsorted(mine, [k, k + step]))
            table[mine[at] - k, where[at]] = share[at]
            self.sums += divergence(table[:, self.rows, None], table[:, None, self.columns]).sum(axis=0)
        if self.key[1] == self.key[2]:
            q = np.zeros(count, np.int64)
            q[number[whole]] = p[whole]
            over = np.flatnonzero(share > q[mine])
            value = divergence(share[over], q[mine[over]])
            rows = np.flatnonzero(~whole)[over]
            at, value = np.concatenate([self.best[0], where[over]]), np.concatenate([self.best[1], value])
            text = self.best[2] + name.take(pa.array(rows)).to_pylist()
            order = np.lexsort((-value, at))  # stable: of equal values the term met first, which is the smaller
            nth = np.arange(len(order)) - np.repeat(first := starts(at[order]), np.diff(first, append=len(order))) if len(order) else order
            order = order[nth < self.top]
            self.best = at[order], value[order], [text[i] for i in order]

    def result(self) -> pa.RecordBatch:
        if self.at is None:
            self.begin()
        i, j = (x.ravel() for x in np.meshgrid(self.rows, self.columns, indexing="ij"))
        value = self.sums.ravel()
        keep = i != j
        i, j, value = i[keep], j[keep], value[keep]
        if self.key[1] != self.key[2]:
            i, j, value = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([value, value])
        names = pa.array(self.names, pa.string())
        best_at, best, terms = self.best
        n = len(i) + len(best)
        part = pa.array(np.repeat(["pair", "term"], [len(i), len(best)]), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([self.key[0]] * n, pa.string()), names.take(pa.array(np.concatenate([i, best_at]))), part, pa.concat_arrays([names.take(pa.array(j)), pa.array(terms, pa.string())]), pa.array(np.concatenate([value, best]))], schema=FOUND)


def swept(rows: DataFrame, top: int) -> DataFrame:
    """Partial (lang, source, part, item, value) of rows sorted by key, term (null: a source's own row) and source."""

    @tidy
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Sweep | None = None
        rest: pa.RecordBatch | None = None  # rows of the term that a batch leaves open: a block of sources at most

        def feed(rows: pa.RecordBatch) -> None:
            if now.at is None:
                now.begin()
            name = rows.column("term")
            now.terms(changes(name), name, rows.column("whole").to_numpy(zero_copy_only=False), rows.column("source").to_pylist(), rows.column("p").to_numpy())

        for batch in batches:
            if not batch.num_rows:
                continue
            if rest is not None:
                batch, rest = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0], None
            key = sum(changes(batch.column(c)) for c in ("lang", "low", "high", "slice"))
            for a, b in zip(first := starts(key), [*first[1:], batch.num_rows], strict=True):
                part = batch.slice(a, b - a)
                here = tuple(part.column(c)[0].as_py() for c in ("lang", "low", "high", "slice"))
                if now is None or now.key != here:
                    if now is not None:
                        yield now.result()
                    now = Sweep(here, top)
                heads = part.column("term").null_count  # they come first
                if heads:
                    now.head(*(part.slice(0, heads).column(c).to_pylist() for c in ("source", "p", "block")))
                part = part.slice(heads)
                if not part.num_rows:
                    continue
                if b < batch.num_rows:
                    feed(part)
                    continue
                last = int(starts(changes(part.column("term")))[-1])
                if last:
                    feed(part.slice(0, last))
                rest = part.slice(last)
        if rest is not None:
            feed(rest)
        if now is not None:
            yield now.result()

    keys = ["lang", "low", "high", "slice"]
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, F.col("term").asc_nulls_first(), F.col("whole").desc(), "source")
    return ordered.mapInArrow(scan, "lang string, source string, part string, item string, value bigint")


def source_divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, block: int = BLOCK) -> DataFrame:
    """Divergence of each source from the other sources of its language, and its most typical terms.

    Returns lang, source, part, item, value, rank. Part `pair` has a row for each other source of the
    language (that is the square of a language's sources, as asked for); part `term` the top_terms terms
    whose share in the group exceeds the language's, by value. Null text, lang and source count as ''.
    A text without terms only makes its group occur; a group without kept terms still has shares and
    pairs; a language without kept terms has pairs of value 0. Ties go by the item's bytes. Repeated rows
    are documents of their own; an empty table gives no rows; other columns are not read. Shares are
    computed in decimals of 38 digits, so every count that a bigint holds is exact.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    slim = docs.select(blank(lang).alias("lang"), blank(source).alias("source"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))
    kept = materialize(kept_terms(document_runs(slim), min_docs), "kept-terms")
    groups = slim.select("lang", "source").distinct()
    totals = kept.groupBy("lang", "whole", "source").agg(F.sum("n").alias("all_n"))
    vocabulary = kept.filter("whole").groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    # numbers of sources inside a language: as many rows as the square root of the result
    numbered = groups.withColumn("block", F.expr(f"cast((row_number() over (partition by lang order by source) - 1) div {block} as int)")).withColumn("whole", F.lit(False))
    blocks = numbered.groupBy("lang").agg((F.max("block") + 1).alias("blocks"))
    every = numbered.unionByName(blocks.select("lang", F.lit("").alias("source"), F.lit(None).cast("int").alias("block"), F.lit(True).alias("whole")))
    base = materialize(
        every.join(totals, ["lang", "whole", "source"], "left").join(vocabulary, "lang", "left").join(blocks, "lang")
        .select("lang", "whole", "source", "block", "blocks", (F.coalesce(wide("all_n"), F.lit(0).cast("decimal(38,0)")) + 2 * F.coalesce(wide("v"), F.lit(0).cast("decimal(38,0)"))).cast("decimal(38,0)").alias("mass")),
        "source-groups",
    )
    share = lambda n: F.expr(f"if(mass = 0, 0L, 1L + cast({SHARE} as decimal(10,0)) * (cast({n} as decimal(20,0)) + 2BD) div mass)")
    slices_ = 1 + kept.count() // SLICE_ROWS
    part_of = lambda b, other: (F.least(b, other).alias("low"), F.greatest(b, other).alias("high"))
    others = F.explode(F.expr("sequence(0, blocks - 1)")).alias("other")
    heads = base.filter("not whole").select("*", others).select("lang", *part_of(F.col("block"), F.col("other")), F.explode(F.sequence(F.lit(0), F.lit(slices_ - 1))).alias("slice"), F.lit(None).cast("string").alias("term"), "whole", "source", share("0").alias("p"), "block")
    shares = kept.join(base, ["lang", "whole", "source"]).select("lang", "whole", "source", "block", "blocks", "term", share("n").alias("p"), F.expr(f"cast(pmod(xxhash64(term), {slices_}) as int)").alias("slice"))
    mine = shares.select("*", others).select("lang", *part_of(F.coalesce("block", "other"), F.col("other")), "slice", "term", "whole", "source", "p", "block")
    found = swept(heads.unionByName(mine), top_terms)
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = found.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(order))
    terms = found.filter("part = 'term'").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_terms)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*columns).unionByName(terms.select(*columns))
