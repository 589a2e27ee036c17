"""Monolingual word alignment of annotated sentence pairs, and the features drawn from it."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.text import ratio, tokenize
from pairloom.operators.tagging import Tagger, tags
from pairloom.sources.tables import shared_table

WORD_SHARE, WINDOW, NER_CAP = 0.75, 3, 3
KINDS = ("n", "a", "v", "pp", "wp", "num")
# Exact tags of the last three kinds.
EXACT = {"pp": "PRP", "wp": "WP", "num": "CD"}
Token = "struct<word:string,pos:string,ner:string,deps:map<int,string>>"


def coarse(pos: str) -> str:
    """n, a, v by the tag's first letter; else empty."""
    return {"N": "n", "J": "a", "V": "v"}.get(pos[:1], "")


def kind_of(pos: str) -> str:
    return coarse(pos) or next((k for k, tag in EXACT.items() if tag == pos), "")


class Similarity:
    """1 for equal words, 0.9 for synonyms of one coarse tag, 0.7 for paraphrases, else 0."""

    def __init__(self, synonyms: set[tuple[str, str, str]] = frozenset(), paraphrases: set[tuple[str, str]] = frozenset()):
        self.synonyms, self.paraphrases = synonyms, paraphrases
        self.entries = defaultdict(list)
        for x, y in {e[-2:] for e in (*synonyms, *paraphrases)}:
            self.entries[x].append((x, y)), self.entries[y].append((x, y))

    def keys(self, token: dict) -> list:
        """Tokens without a common key have similarity 0, so that only those with one are compared. A class that names keys is symmetric."""
        return [token["word"], *self.entries.get(token["word"], ())]

    def __call__(self, a: dict, b: dict) -> float:
        x, y, tag = a["word"], b["word"], coarse(a["pos"])
        if x == y:
            return 1.0
        if tag and tag == coarse(b["pos"]) and ((tag, x, y) in self.synonyms or (tag, y, x) in self.synonyms):
            return 0.9
        return 0.7 if (x, y) in self.paraphrases or (y, x) in self.paraphrases else 0.0


class RowSimilarity(Similarity):
    """The same from the dictionary entries between one pair's own words: (tag, word, other) to 0.9 and ('', word, other) to 0.7."""

    def __init__(self, known: list):
        super().__init__({(k["tag"], k["word"], k["other"]) for k in known if k["tag"]}, {(k["word"], k["other"]) for k in known if not k["tag"]})

    keys = Similarity.keys


class FormSimilarity(Similarity):
    """Stand-in for dictionaries, by word forms: words of one coarse tag that differ by an ending of ENDINGS count as
    synonyms (0.9), and words of five letters or more with equal first four letters as paraphrases (0.7)."""

    ENDINGS = ("ing", "ed", "es", "s", "ly")

    def _stem(self, word: str) -> str:
        return next((word[: -len(e)] for e in self.ENDINGS if word.endswith(e) and len(word) > len(e) + 2), word)

    def keys(self, token: dict) -> list:
        word, tag = token["word"], coarse(token["pos"])
        return [*super().keys(token), *([("stem", tag, self._stem(word))] if tag else []), *([("start", word[:4])] if len(word) >= 5 else [])]

    def __call__(self, a: dict, b: dict) -> float:
        known = super().__call__(a, b)
        if known:
            return known
        x, y, tag = a["word"], b["word"], coarse(a["pos"])
        if tag and tag == coarse(b["pos"]) and self._stem(x) == self._stem(y):
            return 0.9
        return 0.7 if min(len(x), len(y)) >= 5 and x[:4] == y[:4] else 0.0


def _keyed(similarity: Similarity) -> bool:
    """Whether the class names keys itself: a subclass that only changes the values may link more words."""
    return "keys" in vars(type(similarity))


def linked(s: list[dict], t: list[dict], similarity: Similarity) -> dict[tuple[int, int], float]:
    """The similar pairs of places in order, with their similarity."""
    if not _keyed(similarity):
        return {(i, j): x for i, a in enumerate(s) for j, b in enumerate(t) if (x := similarity(a, b)) > 0}
    by = defaultdict(list)
    for j, b in enumerate(t):
        for key in similarity.keys(b):
            by[key].append(j)
    near = ((i, j) for i, a in enumerate(s) for j in sorted({j for key in similarity.keys(a) if key in by for j in by[key]}))
    return {(i, j): x for i, j in near if (x := similarity(s[i], t[j])) > 0}


def diagonal_similarity(s: list[dict], t: list[dict], similarity: Similarity) -> list[float]:
    """Similarity of tokens at equal places, as far as the shorter sentence goes."""
    return [similarity(a, b) for a, b in zip(s, t, strict=False)]


def _edges(sentence: list[dict]) -> list[dict[int, str]]:
    """For each token the tokens that a dependency edge ties to it, with the label, whichever is the head."""
    out: list[dict[int, str]] = [{k: label for k, label in x["deps"].items() if label and k != i and 0 <= k < len(sentence)} for i, x in enumerate(sentence)]
    for i, x in enumerate(sentence):
        for k, label in x["deps"].items():
            if label and k != i and 0 <= k < len(sentence):
                out[k].setdefault(i, label)
    return out


def dependency_context(s: list[dict], t: list[dict], sim: list[list[float]], i: int, j: int) -> list[tuple[int, int]]:
    """Similar pairs (k, l) that hang on (i, j) by equal labels, with equal tags."""
    rows = {k: [m for m in range(len(t)) if sim[k][m] > 0] for k in range(len(s))}
    return _hanging(s, t, rows, _edges(s)[i], _edges(t)[j], i, j)


def _hanging(s: list[dict], t: list[dict], rows: dict[int, list[int]], on_i: dict[int, str], on_j: dict[int, str], i: int, j: int) -> list[tuple[int, int]]:
    if s[i]["pos"] != t[j]["pos"]:
        return []
    return [(k, m) for k in sorted(on_i) for m in rows.get(k, ()) if on_j.get(m) == on_i[k] and s[k]["pos"] == t[m]["pos"]]


def align(s: list[dict], t: list[dict], similarity: Similarity, faithful: bool = True) -> set[tuple[int, int]]:
    """Greedy alignment by dependency context, joined with one by text context.

    Scores fall; ties go by (i, j); a pair needs some similar context. The text pass does not leave
    out what the first pass aligned. In the dependency pass the context of a pair is aligned, too:
    faithful does so for every scored pair, whether it was accepted or not, and then takes (i, j) and not the
    context's tokens as used; otherwise only an accepted pair brings its context, whose tokens are then used.
    """
    return _aligned(s, t, linked(s, t, similarity), faithful)


def _aligned(s: list[dict], t: list[dict], sim: dict[tuple[int, int], float], faithful: bool = True) -> set[tuple[int, int]]:
    """align, from the similar pairs: all work is among them, not among all pairs of places."""
    rows, edges = defaultdict(list), (_edges(s), _edges(t))
    for i, j in sim:
        rows[i].append(j)

    def greedy(context, keep_context: bool) -> set[tuple[int, int]]:
        scored = []
        for i, j in sim:
            if around := context(i, j):
                scored.append((-(WORD_SHARE * sim[i, j] + (1 - WORD_SHARE) * sum(sim[x] for x in around)), i, j, around))
        out, left, right = set(), set(), set()
        for _, i, j, around in sorted(scored, key=lambda x: x[:3]):
            accepted = i not in left and j not in right
            if accepted:
                out.add((i, j)), left.add(i), right.add(j)
            if keep_context and (accepted or faithful):
                for k, m in around:
                    if k not in left and m not in right:
                        out.add((k, m))
                        left.add(i if faithful else k), right.add(j if faithful else m)
        return out

    def near(i: int, j: int) -> list[tuple[int, int]]:
        return [(k, m) for k in range(i - WINDOW, i + WINDOW + 1) if k != i for m in rows.get(k, ()) if m != j and abs(m - j) <= WINDOW]

    return greedy(lambda i, j: _hanging(s, t, rows, edges[0][i], edges[1][j], i, j), True) | greedy(near, False)


def sentence_features(s: list[dict] | None, t: list[dict] | None, similarity: Similarity) -> dict[str, float | None]:
    names = ["S_sem_sim", "T_sem_sim", "sem_sim", *[f"{x}_unmatch_{k}{p}" for x in "ST" for k in KINDS for p in ("", "_p")]]
    if s is None or t is None:
        return dict.fromkeys(names)
    sim = linked(s, t, similarity)
    pairs = _aligned(s, t, sim)
    back = [(j, i) for i, j in sim] if _keyed(similarity) else list(linked(t, s, similarity))
    n, m, k = len(s), len(t), len(pairs)
    out: dict[str, float | None] = {"S_sem_sim": min(1.0, k / n) if n else None, "T_sem_sim": min(1.0, k / m) if m else None, "sem_sim": min(1.0, 2 * k / (n + m)) if n + m else None}
    for side, own, other, links, mine, theirs in (("S", s, t, sim, {i for i, _ in pairs}, {j for _, j in pairs}), ("T", t, s, back, {j for _, j in pairs}, {i for i, _ in pairs})):
        count, lost = defaultdict(int), defaultdict(int)
        free = {i for i, j in links if j not in theirs and kind_of(other[j]["pos"]) == kind_of(own[i]["pos"])}
        for i, a in enumerate(own):
            kind = kind_of(a["pos"])
            count[kind] += 1
            if i not in mine and i not in free:
                lost[kind] += 1
        for kind in KINDS:
            out[f"{side}_unmatch_{kind}"] = float(lost[kind])
            out[f"{side}_unmatch_{kind}_p"] = lost[kind] / count[kind] if count[kind] else 0.0
    return out


def known_pairs(annotated: DataFrame, synonyms: DataFrame, paraphrases: DataFrame | None = None) -> DataFrame:
    """(pair_id, known): the dictionary entries that link a word of s with one of t, in either direction.

    synonyms: (pos, word, other), for words of one coarse tag; paraphrases: (word, other), for any. Dictionaries of
    any size: each is cut to the words of the corpus, then joined by word and by pair, never collected; Spark broadcasts
    one only below its own size limit. A pair's entries are bounded by its words.
    """
    words = lambda c: annotated.select("pair_id", F.explode(c).alias("x")).select("pair_id", F.col("x.word").alias("word"), coarse_column(F.col("x.pos")).alias("tag")).distinct()
    s, t = shared_table(words("s"), "words_s"), shared_table(words("t"), "words_t")
    seen = shared_table(s.select("word", "tag").union(t.select("word", "tag")).distinct(), "words")
    entries = synonyms.select(F.col("pos").alias("tag"), "word", "other").filter("tag <> ''")
    both = entries.union(entries.select("tag", "other", "word")).distinct()
    used = both.join(seen, ["word", "tag"], "left_semi").join(seen.withColumnRenamed("word", "other"), ["other", "tag"], "left_semi")
    found = s.join(used, ["word", "tag"]).join(t.withColumnRenamed("word", "other"), ["pair_id", "tag", "other"], "left_semi").select("pair_id", "tag", "word", "other")
    if paraphrases is not None:
        forms = seen.select("word").distinct()
        loose = paraphrases.select("word", "other").union(paraphrases.select("other", "word")).distinct()
        used = loose.join(forms, "word", "left_semi").join(forms.withColumnRenamed("word", "other"), "other", "left_semi")
        near = s.select("pair_id", "word").distinct().join(used, "word").join(t.select("pair_id", F.col("word").alias("other")).distinct(), ["pair_id", "other"], "left_semi")
        found = found.union(near.select("pair_id", F.lit("").alias("tag"), "word", "other"))
    # lookups go by (s, t) and (t, s), so the entries of one direction are enough
    return found.groupBy("pair_id").agg(F.collect_set(F.struct("tag", "word", "other")).alias("known"))


def coarse_column(pos: Column) -> Column:
    first = F.substring(pos, 1, 1)
    return F.when(first == "N", "n").when(first == "J", "a").when(first == "V", "v").otherwise("")


def sentences(column: pa.Array) -> list[list[dict] | None]:
    """The annotated sentences of an Arrow column as lists of tokens; values are converted by columns, not row by row."""
    parts = dict(zip([f.name for f in column.type.value_type], column.flatten().flatten(), strict=True))
    deps = parts["deps"]
    plain = lambda a: a.to_numpy(zero_copy_only=False).tolist()
    ends, heads, labels = plain(deps.offsets), plain(deps.keys), plain(deps.items)
    tokens = iter([{"word": w, "pos": p, "deps": dict(zip(heads[a:b], labels[a:b], strict=True))} for w, p, a, b in zip(plain(parts["word"]), plain(parts["pos"]), ends, ends[1:], strict=False)])
    return [None if n is None else list(islice(tokens, n)) for n in pc.list_value_length(column).to_pylist()]


def alignment_features(annotated: DataFrame, similarity: Similarity | None = None, synonyms: DataFrame | None = None, paraphrases: DataFrame | None = None) -> DataFrame:
    """The 31 features of annotated pairs (pair_id, s, t); null where a sentence is null or empty.

    Words are similar by `similarity` (a small object that goes to every task; equal words by default), or by dictionary
    tables of any size: synonyms (pos, word, other) and paraphrases (word, other), see known_pairs.
    """
    names = list(sentence_features(None, None, Similarity()))
    surface = surface_columns()
    rows = annotated.select("pair_id", "s", "t", *[c.alias(n) for n, c in surface.items()])
    entries = "array<struct<tag:string,word:string,other:string>>"
    if synonyms is None and paraphrases is None:
        rows = rows.withColumn("known", F.lit(None).cast(entries))
    else:
        empty = annotated.sparkSession.createDataFrame([], "pos string, word string, other string")
        rows = rows.join(known_pairs(annotated, empty if synonyms is None else synonyms, paraphrases), "pair_id", "left").withColumn("known", F.coalesce("known", F.array().cast(entries)))
    fixed = similarity or Similarity()
    kinds, more = dict(rows.dtypes), list(surface)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, t, known = sentences(batch.column(1)), sentences(batch.column(2)), batch.column(3 + len(more)).to_pylist()
            found = [sentence_features(a, b, fixed if k is None else RowSimilarity(k)) for a, b, k in zip(s, t, known, strict=True)]
            columns = [pa.array([f[n] for f in found], pa.float64()) for n in names]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, *batch.columns[3 : 3 + len(more)]], names=["pair_id", *names, *more])

    return rows.mapInArrow(run, ", ".join([f"pair_id {kinds['pair_id']}", *[f"{n} double" for n in names], *[f"{n} {kinds[n]}" for n in more]]))


def surface_columns() -> dict[str, Column]:
    """Unmatched named entities and length differences of s and t."""
    words = lambda c: F.transform(F.col(c), lambda x: x["word"])
    lost = lambda a, b: F.least(F.size(F.filter(F.col(a), lambda x: (x["ner"] != "O") & ~F.array_contains(words(b), x["word"]))), F.lit(NER_CAP))
    diff = F.abs(F.size("s") - F.size("t"))
    return {"S_unmatch_ner": lost("s", "t"), "T_unmatch_ner": lost("t", "s"), "len_dif": diff, "len_dif_p": ratio(2 * diff, F.size("s") + F.size("t"))}


def surface_features(annotated: DataFrame) -> DataFrame:
    """Unmatched named entities and length differences: no alignment needed."""
    return annotated.select("pair_id", *[c.alias(n) for n, c in surface_columns().items()])


def annotation(words: Column) -> Column:
    """Annotated tokens of an array of (word, pos): proper nouns as entities, each word hanging on the one before by a label of its own tag."""

    def token(x: Column, i: Column) -> Column:
        pos = x["pos"]
        label = F.when(pos == "CD", "nummod").when(pos == "VB", "conj").when(pos == "JJ", "amod").when(pos == ".", "punct").otherwise("nmod")
        deps = F.when(i > 0, F.create_map(i - 1, label)).otherwise(F.create_map().cast("map<int,string>"))
        return F.struct(F.lower(x["word"]).alias("word"), pos.alias("pos"), F.when(pos == "NNP", "NAME").otherwise("O").alias("ner"), deps.alias("deps"))

    return F.transform(words, token)


def simple_annotation(text: Column) -> Column:
    """Stand-in annotator: tags by form.

    Numbers are CD, capitalised words NNP with entity NAME, words in -ed or -ing VB, in -ly or -al JJ, other words NN.
    """

    def tagged(w: Column) -> Column:
        pos = F.when(w.rlike(r"^\p{N}+$"), "CD").when(w.rlike(r"^\p{Lu}"), "NNP").when(w.rlike(r"(ed|ing)$"), "VB").when(w.rlike(r"(ly|al)$"), "JJ").when(w.rlike(r"^\p{L}"), "NN").otherwise(".")
        return F.struct(w.alias("word"), pos.alias("pos"))

    return annotation(F.transform(tokenize(text, lower=False), tagged))


def annotated_simply(pairs: DataFrame) -> DataFrame:
    return pairs.select("pair_id", *[simple_annotation(F.coalesce(F.col(f"question{i}"), F.lit("Null"))).alias(x) for i, x in ((1, "s"), (2, "t"))])


def annotated_by(pairs: DataFrame, tagger: Tagger) -> DataFrame:
    """(pair_id, s, t) with the tags of a trained tagger."""

    def side(i: int) -> Column:
        tokens = tokenize(F.coalesce(F.col(f"question{i}"), F.lit("Null")), lower=False)
        return annotation(F.arrays_zip(tokens.alias("word"), tags(tokens, tagger).alias("pos")))

    return pairs.select("pair_id", side(1).alias("s"), side(2).alias("t"))
