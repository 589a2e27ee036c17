"""Quality rules with cross-document line frequency.

One pass over the texts gives each document's base counts and the hashes of its normalised
lines. The number of distinct documents of a host that hold a line is a pre-aggregated count;
lines above the limit are boilerplate of that host, are counted out of every document, and a
document that loses too much of its words is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import free_name, matching, materialize, row_hash, tidy

WORD = re.compile(r"[^\x20\x09-\x0D]+")
NOT_SYMBOL = re.compile(r"[^#*$%&|<>]+")
DIGITS = re.compile(r"\d+")
# A line is boilerplate of its host above MIN_DOCS documents and MIN_SHARE of the host's documents.
MIN_DOCS, MIN_SHARE = 20, 0.01
# A document that loses over this share of its word characters is rejected.
DEPLETED = 0.5


def repeat_words(words: list[str]) -> int:
    """Words inside 3-word windows that occur twice or more in the text, first occurrences included."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    v = len(number)
    if v == n:
        return 0
    # exact: pairs get dense numbers first, so that a window's code fits 64 bits
    pairs = np.unique(ids[:-2] * v + ids[1:-1], return_inverse=True)[1]
    _, window, times = np.unique(pairs * v + ids[2:], return_inverse=True, return_counts=True)
    hit = np.flatnonzero(times[window] > 1)
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[hit + k] = True
    return int(covered.sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = WORD.findall(text)
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += bool(WORD.search(line))
        seen.add(line)
    return len(words), sum(map(len, words)), len(NOT_SYMBOL.sub("", text)), dup, repeat_words(words)


def line_key(line: str) -> tuple[int, int] | None:
    """(hash of the normalised line, its word characters); None for a line without a word.

    Normalised: lower case, digit runs as one 0, white space as one space.
    """
    words = WORD.findall(line)
    if not words:
        return None
    return xxhash.xxh3_64_intdigest(DIGITS.sub("0", " ".join(words).lower()).encode("utf-8", "surrogatepass")) - (1 << 63), sum(map(len, words))


FACTS = pa.schema([("key", pa.int64()), ("row", pa.int64()), ("host", pa.string())] + [(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [("lines", pa.list_(pa.int64())), ("chars", pa.list_(pa.int64()))])


def document_facts(docs: DataFrame, key: str, text: str, host: str) -> DataFrame:
    """Base counts and, in `lines` and `chars`, each distinct line hash with its word characters (all occurrences)."""

    @tidy
    def facts(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out: list[list] = [[] for _ in FACTS]
            for k, r, h, x in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                t = x.as_py() or ""
                lines: dict[int, int] = {}
                for line in t.split("\n"):
                    if found := line_key(line):
                        lines[found[0]] = lines.get(found[0], 0) + found[1]
                for c, v in zip(out, (k, r, h, *base_counts(t), list(lines), list(lines.values())), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, FACTS, strict=True)], schema=FACTS)

    schema = "key bigint, row bigint, host string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, lines array<bigint>, chars array<bigint>"
    # a null host is a host of its own, marked by a character that names don't hold
    return docs.select(F.col(key).cast("long").alias("key"), row_hash(key, text).alias("row"), F.coalesce(F.col(host), F.lit("\0")).alias("host"), F.col(text).alias("text")).mapInArrow(facts, schema)


def host_lines(facts: DataFrame) -> DataFrame:
    """(key, row, host, line, chars) of each distinct line of a document."""
    return facts.select("key", "row", "host", F.explode(F.arrays_zip("lines", "chars")).alias("x")).select("key", "row", "host", F.col("x.lines").alias("line"), F.col("x.chars").alias("chars"))


def boilerplate(facts: DataFrame, min_docs: int, min_share: float) -> DataFrame:
    """(key, row, host, line, chars) of the lines above the limits, once for rows that are equal in key, text and host."""
    lines = host_lines(facts)
    # one row a line on the small side; AQE splits the partitions of very common lines
    return lines.join(frequent_lines(facts, lines, min_docs, min_share), ["host", "line"]).groupBy("key", "row", "host", "line").agg(F.max("chars").alias("chars"))


#: A row is known by its key, the hash of key and text, and its host; null keys are keys.
SAME_ROW = {"key": "_key", "row": "_row", "host": "_host"}


def frequent_lines(facts: DataFrame, lines: DataFrame, min_docs: int, min_share: float) -> DataFrame:
    """(host, line) of the lines above the limits."""
    sizes = facts.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    # lines of a document are distinct, so rows are documents; counts are summed before the shuffle
    return (
        lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") > min_docs)
        .join(sizes, "host").filter(F.col("docs") > min_share * F.col("host_docs")).select("host", "line")
    )


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE, depleted: float = DEPLETED) -> DataFrame:
    """Base rule and line-frequency verdict of every document.

    Returns key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept and boilerplate_chars (word characters in lines above the limits). Null and empty
    texts have no words and fail the base rule. Null hosts form one host. Rows that repeat a key, or
    have a null one, are documents of their own, for the line counts and for the verdict. An empty table gives no
    rows; other columns are not read.
    """
    facts = materialize(document_facts(docs, key, text, host), "quality")
    lost = boilerplate(facts, min_docs, min_share).groupBy("key", "row", "host").agg(F.sum("chars").alias("boilerplate_chars")).withColumnsRenamed(SAME_ROW)
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        matching(facts.drop("lines", "chars"), lost, SAME_ROW, "left")
        .withColumn("boilerplate_chars", F.coalesce("boilerplate_chars", F.lit(0)))
        .withColumn("base_failed", base_failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("boilerplate_chars") <= depleted * F.col("word_chars")))
        .select(F.col("key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "boilerplate_chars")
    )


def without_boilerplate(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """docs with the lines above the limits taken out of `text`, and their positions from 0 in `removed` (with underscores before it if docs has such a column).

    The lines are those that quality_rules counts. Null texts stay null, null keys are keys, and rows that repeat a
    key lose their own lines only. Other columns stay, whatever their names.
    """
    facts = materialize(document_facts(docs, key, text, host), "quality")
    taken = list(docs.columns)
    names = {}
    for n in ("removed", "lost", "key", "row", "host", "line_key", "line_row", "line_host"):
        names[n] = free_name(taken, n)
        taken.append(names[n])
    # bounded by the lines of one document
    lost = boilerplate(facts, min_docs, min_share).groupBy("key", "row", "host").agg(F.collect_set("line").alias(names["lost"]))
    lost = lost.withColumnsRenamed({n: names[f"line_{n}"] for n in ("key", "row", "host")})
    named = docs.withColumns({names["key"]: F.col(key).cast("long"), names["row"]: row_hash(key, text), names["host"]: F.coalesce(F.col(host), F.lit("\0"))})

    @F.pandas_udf("removed array<int>, cleaned string")
    def cut(texts: pd.Series, drops: pd.Series) -> pd.DataFrame:
        rows = []
        for t, d in zip(texts, drops, strict=True):
            if t is None or d is None:
                rows.append(([], t))
                continue
            gone, split = set(map(int, d)), t.split("\n")
            at = [i for i, line in enumerate(split) if (k := line_key(line)) is not None and k[0] in gone]
            out = set(at)
            rows.append((at, "\n".join(x for i, x in enumerate(split) if i not in out)))
        return pd.DataFrame(rows, columns=["removed", "cleaned"])

    joined = matching(named, lost, {names[n]: names[f"line_{n}"] for n in ("key", "row", "host")}, "left").withColumn(names["lost"], cut(F.col(text), F.col(names["lost"])))
    return joined.withColumn(text, F.col(names["lost"])["cleaned"]).withColumn(names["removed"], F.col(names["lost"])["removed"]).select(*docs.columns, names["removed"])
