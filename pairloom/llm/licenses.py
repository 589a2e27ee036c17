"""License scans: an exact set-similarity join of text blocks with license templates.

Column functions and joins only. Tokens are ordered by their frequency in the whole corpus, rarest
first. A template of m tokens has to share need = ceil(threshold m) of them with a block, so one of its
first m - need + 1 tokens (its prefix) is in every block that it matches: blocks are found by their
prefix tokens, which are the corpus's rarest. Length and position bounds then drop pairs, and
intersections decide the rest.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.common import materialize, row_hash

#: What separates words; the rest of a text are digits, ASCII letters and everything beyond ASCII.
GAPS = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
GAP, WORD_CHAR = f"[{GAPS}]", f"[^{GAPS}]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Phrases that make a label wherever they stand.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: A block holds a template if it has this share of its tokens, in hundredths.
THRESHOLD = 85
#: A line is a block; one of more words is cut into blocks of BLOCK words, a new one each STRIDE words.
BLOCK, STRIDE = 96, 48
# Sentences that grant a license, in the words of the licenses themselves or of the usual notices.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT license."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3", "Released under the GNU GPL v3 license."),
    ("gpl-2", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl-3", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("agpl-3", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
]


def words_of(text: Column) -> Column:
    """Words of a text in its own case."""
    return F.array_remove(F.split(text, f"{GAP}+"), "")


def lower(text: Column) -> Column:
    """A-Z only in lower case."""
    return F.translate(text, UPPER, LOWER)


def phrase_pattern(phrase: str) -> str:
    """Finds a phrase in a raw text; the flag folds ASCII only."""
    return f"(?i)(?<!{WORD_CHAR})" + f"{GAP}+".join(phrase.split()) + f"(?!{WORD_CHAR})"


def phrase_places(words: Column, phrase: str) -> Column:
    """Places of the words, from 0, where a phrase starts. words: in lower case."""

    def match(i: Column) -> Column:
        each = [F.get(words, i + k) == F.lit(w) for k, w in enumerate(phrase.split())]
        return F.coalesce(reduce(Column.__and__, each), F.lit(False))

    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), match)


def with_phrases(docs: DataFrame, text: str, phrases: dict[str, str]) -> DataFrame:
    """docs(text) with n_words, places (of all phrases) and found (their labels).

    Lists of the words of a whole text are only made where a pattern finds some phrase in it.
    """
    body, none = F.coalesce(F.col(text), F.lit("")), F.array().cast("array<int>")
    some = reduce(Column.__or__, [body.rlike(phrase_pattern(p)) for p in phrases], F.lit(False))
    words = docs.withColumn("n_words", F.size(words_of(body)).cast("long")).withColumn("words", F.when(some, words_of(lower(body))))
    each = [F.when(F.col("words").isNotNull(), phrase_places(F.col("words"), p)) for p in phrases]
    at = words.withColumn("each", F.array(none, *[F.coalesce(e, none) for e in each]))
    labels = [F.when(F.size(F.get("each", F.lit(i))) > 0, F.lit(label)) for i, label in enumerate(phrases.values(), 1)]
    return at.withColumn("places", F.flatten("each")).withColumn("found", F.array_compact(F.array(F.lit(None).cast("string"), *labels))).drop("words", "each")


def text_blocks(docs: DataFrame, key: Column, row: Column, text: str) -> DataFrame:
    """(key, row, line, block, tokens): distinct lower-cased words of each block of a text, those of its lines."""
    lines = docs.select(key.alias("key"), row.alias("row"), F.posexplode(F.split(F.col(text), "\n")).alias("line", "body"))
    words = lines.select("key", "row", "line", F.array_remove(F.split(lower(F.col("body")), f"{GAP}+"), "").alias("words")).filter("size(words) > 0")
    starts = F.when(F.size("words") <= BLOCK, F.array(F.lit(1))).otherwise(F.sequence(F.lit(1), F.size("words") - BLOCK + STRIDE, F.lit(STRIDE)))
    return words.select("key", "row", "line", "words", F.explode(starts).alias("block")).select("key", "row", "line", "block", F.array_distinct(F.expr(f"slice(words, block, {BLOCK})")).alias("tokens"))


def template_table(spark: SparkSession, templates: Sequence[tuple[str, str]]) -> DataFrame:
    """(label, template) rows; the texts are those of the list."""
    return spark.createDataFrame([*templates] or [], "label string, template string")


def containment_join(blocks: DataFrame, templates: DataFrame, threshold: int) -> DataFrame:
    """(key, row, line, block, label, template, overlap, size) of all blocks with threshold % of a template's tokens.

    blocks: as text_blocks gives them; templates: (label, template), of any number. Templates without a
    word match nothing; equal templates of one label count once.
    """
    numbered = templates.select("label", "template", F.array_distinct(words_of(lower(F.col("template")))).alias("tokens")).filter("size(tokens) > 0").dropDuplicates(["label", "template"])
    # small tables are written first, so that Spark knows their size when it picks a join: templates of any number stay right
    vocabulary = materialize(numbered.select(F.explode("tokens").alias("token")).distinct().coalesce(1), "template-tokens")
    # frequencies of the templates' tokens over all blocks; the others never match and need no place in the order
    counts = blocks.select(F.explode("tokens").alias("token")).join(vocabulary, "token").groupBy("token").agg(F.count(F.lit(1)).alias("blocks"))
    ranks = materialize(vocabulary.join(counts, "token", "left").select("token", F.struct(F.coalesce("blocks", F.lit(0)).alias("blocks"), "token").alias("rank")).coalesce(1), "token-order")
    need = F.expr(f"cast((size(ranks) * {threshold} + 99) div 100 as int)")
    ordered = materialize(
        numbered.select("label", "template", F.explode("tokens").alias("token")).join(ranks, "token")
        .groupBy("label", "template").agg(F.sort_array(F.collect_list("rank")).alias("ranks")).withColumn("need", need).coalesce(1), "templates"
    )
    prefix = ordered.select("label", "template", F.posexplode(F.expr("slice(ranks, 1, size(ranks) - need + 1)")).alias("at", "rank"), "need", F.size("ranks").alias("size")).withColumn("token", F.col("rank.token"))
    prefix = materialize(prefix.coalesce(1), "prefixes")
    # length: a block of fewer words than a template's need can't hold it
    hits = materialize(blocks.withColumn("token", F.explode("tokens")).join(prefix, "token").filter(F.size("tokens") >= F.col("need")).drop("token"), "prefix-hits")
    one = ["key", "row", "line", "block"]
    # blocks in the corpus's order, of the templates' tokens only; a block is bounded, so is its group
    known = hits.groupBy(*one).agg(F.first("tokens").alias("tokens")).select(*one, F.explode("tokens").alias("token")).join(ranks, "token").groupBy(*one).agg(F.sort_array(F.collect_list("rank")).alias("sorted"))
    right = known.select(*[F.col(c).alias(f"_{c}") for c in one], "sorted")
    placed = hits.join(right, [hits[c].eqNullSafe(right[f"_{c}"]) for c in one]).drop(*[f"_{c}" for c in one], "tokens")
    rest = F.least(F.col("size") - F.col("at"), F.size("sorted") - F.array_position("sorted", F.col("rank")).cast("int") + 1)
    left = placed.filter((F.size("sorted") >= F.col("need")) & (rest >= F.col("need"))).select(*one, "label", "template", "need", "sorted").dropDuplicates([*one, "label", "template"])
    overlap = F.size(F.array_intersect("ranks", "sorted"))
    return left.join(ordered.drop("need"), ["label", "template"]).withColumn("overlap", overlap).filter(F.col("overlap") >= F.col("need")).select(*one, "label", "template", "overlap", F.size("ranks").alias("size"))


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: DataFrame | None = None, phrases: dict[str, str] | None = None, threshold: int = THRESHOLD) -> DataFrame:
    """License labels of every document: those of PHRASES and those of templates that a block holds.

    Returns key, n_words, n_base (places of the phrases), first_word and last_word (the first and last of
    them, else null), base_labels, labels (with the templates' ones; both sorted and comma-joined, '' for
    none) and score: 1 with a phrase, else the largest share of a template's tokens in a block that holds
    it, 0 without label. A block is a line, or BLOCK words of a longer line. Null and empty texts have no
    words; rows that repeat a key are documents of their own; an empty table gives no rows; other columns
    are not read. Whole texts are read twice (token order, then blocks) besides the count of words.
    """
    phrases = PHRASES if phrases is None else phrases
    templates = template_table(docs.sparkSession, TEMPLATES) if templates is None else templates
    slim = docs.select(F.col(key).alias("key"), row_hash(key, text).alias("row"), F.col(text).alias("text"))
    held = containment_join(text_blocks(slim, F.col("key"), F.col("row"), "text"), templates, threshold)
    more = held.groupBy("key", "row").agg(F.collect_set("label").alias("more"), F.max(F.col("overlap") / F.col("size")).alias("share")).withColumnsRenamed({"key": "_key", "row": "_row"})
    base = with_phrases(slim, "text", phrases).drop("text")
    none = F.array().cast("array<string>")
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return base.join(more, F.col("key").eqNullSafe(F.col("_key")) & (F.col("row") == F.col("_row")), "left").select(
        F.col("key").alias(key), "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        joined("found").alias("base_labels"), joined(F.array_union("found", F.coalesce("more", none))).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
