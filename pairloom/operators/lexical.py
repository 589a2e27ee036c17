"""Lexical pair features: one DataFrame -> DataFrame function for each family, keyed by pair_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.grams import SIMHASH_KINDS, gram_overlaps, simhash_distances
from pairloom.functions.text import common, ngrams, only_stops, q_text, ratio, ratio_or_zero, split_words, tokenize, without_stops
from pairloom.sources.tables import spread

QUESTION_WORDS = ("how", "what", "which", "who", "where", "when", "why")


def with_texts(pairs: DataFrame, null_as: str = "nan") -> DataFrame:
    return pairs.withColumns({"a": q_text("question1", null_as), "b": q_text("question2", null_as)})


def length_features(pairs: DataFrame) -> DataFrame:
    p = with_texts(pairs).select("pair_id", F.length("a").alias("char_len1"), F.length("b").alias("char_len2"), F.size(split_words(F.col("a"))).alias("word_len1"), F.size(split_words(F.col("b"))).alias("word_len2"))
    diff = lambda x: ratio(F.abs(F.col(f"{x}1") - F.col(f"{x}2")), F.col(f"{x}1") + F.col(f"{x}2"))
    return p.withColumns({"char_len_diff_ratio": diff("char_len"), "word_len_diff_ratio": diff("word_len")})


def capital_features(pairs: DataFrame) -> DataFrame:
    caps = lambda c: F.length(F.regexp_replace(c, r"[^\p{Lu}]", ""))
    mean = lambda c: ratio(F.length(F.replace(F.col(c), F.lit(" "), F.lit(""))), F.size(split_words(F.col(c))))
    p = with_texts(pairs).select("pair_id", caps("a").alias("caps_count_q1"), caps("b").alias("caps_count_q2"), mean("a").alias("avg_world_len1"), mean("b").alias("avg_world_len2"))
    return p.withColumns({"diff_caps": F.col("caps_count_q1") - F.col("caps_count_q2"), "diff_avg_word": F.col("avg_world_len1") - F.col("avg_world_len2")})


def question_word_features(pairs: DataFrame) -> DataFrame:
    """Substring tests on the lower-case text, so 'show' holds 'how'."""
    p = with_texts(pairs).select("pair_id", F.lower("a").alias("a"), F.lower("b").alias("b"))
    cols: dict[str, Column] = {}
    for w in QUESTION_WORDS:
        cols[f"q1_{w}"], cols[f"q2_{w}"] = F.contains(F.col("a"), F.lit(w)).cast("int"), F.contains(F.col("b"), F.lit(w)).cast("int")
        cols[f"{w}_both"] = cols[f"q1_{w}"] * cols[f"q2_{w}"]
    return p.select("pair_id", *[c.alias(n) for n, c in cols.items()])


def capped_length_features(pairs: DataFrame) -> DataFrame:
    """Length difference and ratio, capped at max + 2 sample deviations over train duplicates, and their logs."""
    p = with_texts(pairs, "").select("pair_id", "split", "is_duplicate", F.length("a").cast("double").alias("len1"), F.length("b").cast("double").alias("len2"))
    one = lambda c: F.when(F.col(c) > 0, F.col(c)).otherwise(1.0)
    p = p.withColumns({"diff": F.abs(F.col("len1") - F.col("len2")), "rat": one("len1") / one("len2")})
    cap = lambda c: F.max(c) + 2 * F.stddev_samp(c)
    caps = p.filter("split = 'train' and is_duplicate = 1").agg(cap("diff").alias("cap_diff"), cap("rat").alias("cap_rat"))  # one row
    p = p.crossJoin(F.broadcast(caps)).withColumns({"abs_diff_len1_len2": F.least("diff", "cap_diff"), "ratio_len1_len2": F.least("rat", "cap_rat")})
    return p.select("pair_id", "len1", "len2", "abs_diff_len1_len2", F.log(F.col("abs_diff_len1_len2") + 1).alias("log_abs_diff_len1_len2"), "ratio_len1_len2", F.log(F.col("ratio_len1_len2") + 1).alias("log_ratio_len1_len2"))


def nouns(text: Column) -> Column:
    """Stand-in tagger: words of four letters or more that are no stop words, with repeats."""
    return F.filter(without_stops(tokenize(text)), lambda w: F.length(w) >= 4)


def match_features(pairs: DataFrame, noun_tagger=nouns, tokenizer=tokenize) -> DataFrame:
    """Noun, word and n-gram matches; noun_tagger is a Column -> Column of noun tokens, tokenizer one of all tokens."""
    p = with_texts(pairs)
    p = p.select(
        "pair_id", F.array_distinct(without_stops(split_words(F.col("a")))).alias("w1"), F.array_distinct(without_stops(split_words(F.col("b")))).alias("w2"),
        without_stops(tokenizer(F.col("a"))).alias("u1"), without_stops(tokenizer(F.col("b"))).alias("u2"), noun_tagger(F.col("a")).alias("n1"), noun_tagger(F.col("b")).alias("n2"),
    )
    matched = F.size(F.filter("n1", lambda w: F.array_contains("n2", w)))
    cols = {
        "noun_match_count": matched,
        "noun_match_ratio": ratio_or_zero(matched, F.size("n1") + F.size("n2")),
        "word_match_ratio": word_match_ratio(F.col("w1"), F.col("w2")),
    }
    for name, n in (("unigrams", 1), ("bigrams", 2), ("trigrams", 3)):
        a, b = ngrams(F.col("u1"), n), ngrams(F.col("u2"), n)
        cols[f"{name}_nostop_match_count"] = common(a, b)
        cols[f"{name}_nostop_match_ratio"] = common(a, b) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))
    return p.select("pair_id", *[c.alias(n) for n, c in cols.items()])


def word_match_ratio(w1: Column, w2: Column) -> Column:
    """Shared distinct words over all of them, twice; 0 if either side has none."""
    return F.when((F.size(w1) == 0) | (F.size(w2) == 0), 0.0).otherwise(ratio_or_zero(2 * common(w1, w2), F.size(w1) + F.size(w2)))


def word_weights(pairs: DataFrame, eps: int = 10000, least: int = 2) -> DataFrame:
    """(word, weight) of the training questions: 0 below `least` occurrences, else 1 / (count + eps)."""
    words = with_texts(pairs.filter("split = 'train'")).select(F.explode(F.array("a", "b")).alias("q")).select(F.explode(split_words(F.col("q"))).alias("word"))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("word", F.when(F.col("n") < least, 0.0).otherwise(1.0 / (F.col("n") + eps)).alias("weight"))


def weighted_share_features(pairs: DataFrame) -> DataFrame:
    """Shares by word weight and by count, stop-word ratios, shared bigrams and positions."""
    p = with_texts(pairs).select("pair_id", split_words(F.col("a")).alias("l1"), split_words(F.col("b")).alias("l2"))
    p = p.withColumns({"s1": F.array_distinct(without_stops(F.col("l1"))), "s2": F.array_distinct(without_stops(F.col("l2")))})
    # each distinct word of a pair once, with its sides, joined to its weight: no vocabulary in one place
    sides = p.select("pair_id", "s1", "s2", F.explode(F.array_union("s1", "s2")).alias("word"))
    sides = sides.select("pair_id", "word", F.array_contains("s1", F.col("word")).cast("int").alias("in1"), F.array_contains("s2", F.col("word")).cast("int").alias("in2"))
    w = sides.join(word_weights(pairs), "word", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    both, sq = F.col("in1") * F.col("in2") * F.col("weight"), F.col("weight") * F.col("weight")
    sums = w.groupBy("pair_id").agg(
        F.sum(both).alias("shared"), F.sum(F.col("weight") * (F.col("in1") + F.col("in2"))).alias("total"),
        F.sum(both * F.col("weight")).alias("dot"), F.sqrt(F.sum(sq * F.col("in1"))).alias("norm1"), F.sqrt(F.sum(sq * F.col("in2"))).alias("norm2"),
    )
    none = (F.size("s1") == 0) | (F.size("s2") == 0)
    n = common(F.col("s1"), F.col("s2"))
    t1, t2 = F.array_distinct(only_stops(F.col("l1"))), F.array_distinct(only_stops(F.col("l2")))
    b1, b2 = F.array_distinct(ngrams(F.col("l1"), 2)), F.array_distinct(ngrams(F.col("l2"), 2))
    same = F.size(F.filter(F.zip_with("l1", "l2", lambda x, y: x == y), lambda e: e))
    or_zero = lambda c: F.when(none, 0.0).otherwise(c)
    out = p.join(sums, "pair_id", "left").select(
        "pair_id",
        or_zero(ratio(F.col("shared"), F.col("total"))).alias("word_match_ratio_2"),
        or_zero(ratio(n, F.size("s1") + F.size("s2") - n)).alias("tfidf_word_match_ratio_2"),
        F.when(none, 0).otherwise(n).alias("shared_count_2"),
        or_zero(ratio(F.size(t1), F.size("s1"))).alias("stops1_ratio"), or_zero(ratio(F.size(t2), F.size("s2"))).alias("stops2_ratio"),
        or_zero(ratio_or_zero(common(b1, b2), F.size(b1) + F.size(b2))).alias("shared_2gram"),
        or_zero(ratio(F.col("dot"), F.col("norm1") * F.col("norm2"))).alias("word_match_cosine"),
        or_zero(ratio(same, F.greatest(F.size("l1"), F.size("l2")))).alias("words_hamming"),
    )
    return out.withColumns({"word_match_ratio_2_root": F.sqrt("word_match_ratio_2"), "diff_stops_r": F.col("stops1_ratio") - F.col("stops2_ratio")})


def simhash_features(pairs: DataFrame) -> DataFrame:
    """Hamming distances of simhashes over tokens, word and character n-grams."""
    p = spread(with_texts(pairs).select("pair_id", without_stops(tokenize(F.col("a"), lower=False)).alias("k1"), without_stops(tokenize(F.col("b"), lower=False)).alias("k2")))
    found = p.select("pair_id", simhash_distances("k1", "k2").alias("d"))
    return found.select("pair_id", *[F.col(f"d.{name}").alias(f"simhash_{name}_distance") for name in SIMHASH_KINDS])


def char_jaccard_features(pairs: DataFrame) -> DataFrame:
    """Set and multiset Jaccard of character 1- to 3-grams of the lower-case text; 0 where a trigram denominator is 0."""
    p = spread(with_texts(pairs, "").select("pair_id", F.lower("a").alias("a"), F.lower("b").alias("b"))).select("pair_id", gram_overlaps("a", "b").alias("n"))
    cols = {}
    for name, n in (("unigram", 1), ("bigram", 2), ("trigram", 3)):
        shared, either, low, total = (F.col(f"n.{what}{n}") for what in ("shared", "either", "low", "total"))
        div = ratio_or_zero if n == 3 else ratio
        cols[f"{name}_jaccard"] = div(shared, either)
        cols[f"{name}_all_jaccard"] = div(low, total)
        cols[f"{name}_all_jaccard_max"] = div(low, total - low)
    cols["bigram_jaccard"] = F.least(F.lit(1.0), F.greatest(F.lit(-1.478751), cols["bigram_jaccard"]))
    return p.select("pair_id", *[c.alias(n) for n, c in cols.items()])


def term_totals(pairs: DataFrame) -> DataFrame:
    """(term, total): how often each word stands in all questions of both sides (the column sums of the counts)."""
    texts = F.array(*[split_words(q_text(f"question{i}", "")) for i in (1, 2)])
    return pairs.select(F.explode(F.flatten(texts)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("total"))
