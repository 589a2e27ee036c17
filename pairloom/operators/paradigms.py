"""A lemmatiser learned from a vocabulary: endings that many stems exchange, with a base ending for each.

Words are cut into stem and ending in all ways. Endings that occur with many stems are candidates; two of them that
share enough stems make a rule from the rarer to the more frequent one. A word's lemma is its stem with the
base ending, for the longest ending whose lemma is a word itself.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Shortest stem, longest ending, endings that are looked at, and stems that two endings must share.
STEM, ENDING, ENDINGS, SUPPORT = 3, 4, 64, 5


def cuts(words: DataFrame) -> DataFrame:
    """(word, n, stem, ending) of all cuts of words of letters."""
    at = F.sequence(F.greatest(F.lit(STEM), F.length("word") - ENDING), F.length("word"))
    cut = words.filter(F.col("word").rlike(r"^\p{L}+$") & (F.length("word") >= STEM)).select("word", "n", F.explode(at).alias("k"))
    return cut.select("word", "n", F.substring("word", F.lit(1), F.col("k")).alias("stem"), F.substring("word", F.col("k") + 1, F.lit(ENDING)).alias("ending"))


def mined(words: DataFrame, endings: int = ENDINGS, support: int = SUPPORT) -> dict[str, str]:
    """Rules ending -> base ending, at most one an ending, of words (word, n: occurrences), distinct.

    The base of an ending is the one that shares most stems with it among those whose words occur more often over the shared
    stems (if equally often, the shorter and then the smaller one); ties by shorter, then smaller. At most
    `endings` rules come to the driver; a stem has at most as many endings, so no group grows with the corpus.
    """
    rows = cuts(words)
    # the most productive endings; ties by the smaller one
    known = rows.groupBy("ending").agg(F.count(F.lit(1)).alias("stems")).orderBy(F.col("stems").desc(), "ending").limit(endings).select("ending")
    kept = rows.join(F.broadcast(known), "ending").select("stem", "ending", "n")
    a, b = kept.select("stem", F.col("ending").alias("e"), F.col("n").alias("n1")), kept.select("stem", F.col("ending").alias("base"), F.col("n").alias("n2"))
    both = a.join(b, "stem").filter("e <> base").groupBy("e", "base").agg(F.count(F.lit(1)).alias("stems"), F.sum("n1").alias("n1"), F.sum("n2").alias("n2"))
    longer = F.struct(F.length("base"), F.col("base")) < F.struct(F.length("e"), F.col("e"))
    rules = both.filter((F.col("stems") >= support) & ((F.col("n2") > F.col("n1")) | ((F.col("n2") == F.col("n1")) & longer)))
    best = rules.withColumn("rank", F.row_number().over(Window.partitionBy("e").orderBy(F.col("stems").desc(), F.length("base"), "base"))).filter("rank = 1")
    return {r["e"]: r["base"] for r in best.select("e", "base").collect()}


def lemma_table(words: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(word, lemma) of distinct words (word, n): the longest ending with a rule whose lemma is in the vocabulary, else the word."""
    if not rules:
        return words.select("word", F.col("word").alias("lemma"))
    table = words.sparkSession.createDataFrame(sorted(rules.items()), "ending string, base string")
    tried = cuts(words).join(F.broadcast(table), "ending").select("word", F.concat("stem", "base").alias("lemma"), F.length("ending").alias("size"))
    found = tried.join(words.select(F.col("word").alias("lemma")), "lemma", "left_semi").groupBy("word").agg(F.max_by("lemma", "size").alias("lemma"))
    return words.select("word").join(found, "word", "left").select("word", F.coalesce("lemma", "word").alias("lemma"))


@dataclass
class Lemmatiser:
    """The rules as a trie of reversed endings, for words outside the vocabulary: the longest ending with a rule is exchanged."""

    rules: dict[str, str]
    root: dict = field(default_factory=dict, init=False)

    def __post_init__(self) -> None:
        for ending, base in self.rules.items():
            node = self.root
            for c in reversed(ending):
                node = node.setdefault(c, {})
            node[""] = base

    def __call__(self, word: str, known=lambda w: True) -> str:
        """known: whether a lemma may be given."""
        node, best = self.root, word
        for k in range(len(word), STEM - 1, -1):
            if "" in node and known(word[:k] + node[""]):
                best = word[:k] + node[""]
            node = node.get(word[k - 1])
            if node is None:
                break
        return best
