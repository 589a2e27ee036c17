"""A part-of-speech tagger learned without labels: a hidden Markov model fitted by expectation maximisation.

Closed-class words, numbers and punctuation may have one tag only, other words the open tags, weighted at first
by their endings. Each round, tasks sum the expected counts of their sentences (forward-backward in scaled numbers, all
sentences of one length of a batch at once) and send one row a nonzero count; the driver holds the model,
which is tags times the bounded vocabulary. Viterbi paths give the tags.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.text import q_text, tokenize
from pairloom.sources.tables import shared_table, spread

TAGS = ("NN", "NNP", "VB", "JJ", "RB", "CD", "PRP", "WP", "DT", "IN", ".")
# Closed-class words with their tags.
CLOSED = {
    "DT": "a an the this that these those some any each every no",
    "IN": "of in on at by for with from to into about as than if or and but because between through during before after over under",
    "PRP": "i you he she it we they me him her us them",
    "WP": "who whom what which when where why how whose",
    "VB": "is am are was were be been being do does did have has had can could will would shall should may might must",
}
# First weights of the open tags by the ending of a word.
ENDINGS = {"ing": "VB", "ed": "VB", "ly": "RB", "al": "JJ", "ous": "JJ", "ive": "JJ", "ful": "JJ", "ion": "NN", "ness": "NN", "ment": "NN"}
OPEN = {"NN": 0.55, "VB": 0.2, "JJ": 0.2, "RB": 0.05}
VOCABULARY, ROUNDS, CAPITAL = 20_000, 8, "^"


def symbols(tokens: Column) -> Column:
    """Tokens in lower case; capitalised ones that do not begin the text carry a mark."""
    return F.transform(tokens, lambda w, i: F.concat(F.when((i > 0) & w.rlike(r"^\p{Lu}"), CAPITAL).otherwise(""), F.lower(w)))


def rare(symbol: str) -> str:
    """The class that stands for a symbol outside the vocabulary: mark, kind and ending."""
    mark, word = (CAPITAL, symbol[1:]) if symbol[:1] == CAPITAL and len(symbol) > 1 else ("", symbol)
    if word.isnumeric():
        return "<number>"
    if not any(c.isalnum() for c in word):
        return "<mark>"
    return f"{mark}<{next((e for e in ENDINGS if word.endswith(e)), '')}>"


CLASSES = ["<number>", "<mark>", *[f"{m}<{e}>" for m in ("", CAPITAL) for e in ("", *ENDINGS)]]


def prior(symbol: str) -> np.ndarray:
    """First weights of the tags of a symbol; tags of weight 0 never become possible."""
    out = np.zeros(len(TAGS))
    word = symbol.lstrip(CAPITAL)
    closed = next((tag for tag, words in CLOSED.items() if word in words.split()), None)
    kind = rare(symbol) if symbol not in CLASSES else symbol
    if closed:
        out[TAGS.index(closed)] = 1
    elif kind == "<number>":
        out[TAGS.index("CD")] = 1
    elif kind == "<mark>":
        out[TAGS.index(".")] = 1
    else:
        for tag, share in OPEN.items():
            out[TAGS.index(tag)] = share
        ending = ENDINGS.get(kind.strip(CAPITAL)[1:-1])
        if ending:
            out *= 0.4
            out[TAGS.index(ending)] += 0.6
        if symbol[:1] == CAPITAL:
            out *= 0.3
            out[TAGS.index("NNP")] = 0.7
    return out


@dataclass
class Tagger:
    number: dict[str, int]
    start: np.ndarray
    step: np.ndarray  # tag to next tag
    emit: np.ndarray  # symbol to tag
    likelihood: list[float] = field(default_factory=list)

    def ids(self, sentence: list[str]) -> list[int]:
        return [self.number[s] if s in self.number else self.number[rare(s)] for s in sentence]

    def expected(self, ids: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected starts, steps and emissions (a row a place of ids), and the log likelihood, of sentences of one length (a row each); times: how often each occurs."""
        times = np.ones(len(ids)) if times is None else times
        seen = self.emit[ids]
        n, size, _ = seen.shape
        forward, scale = np.empty_like(seen), np.empty((n, size))
        for t in range(size):
            now = (self.start if t == 0 else forward[:, t - 1] @ self.step) * seen[:, t]
            scale[:, t] = now.sum(axis=1)
            forward[:, t] = now / scale[:, t, None]
        steps = np.zeros_like(self.step)
        backward, gamma = np.ones((n, len(TAGS))), np.empty_like(seen)
        gamma[:, -1] = forward[:, -1]
        for t in range(size - 2, -1, -1):
            ahead = seen[:, t + 1] * backward / scale[:, t + 1, None]
            steps += forward[:, t].T @ (ahead * times[:, None])
            backward = ahead @ self.step.T
            gamma[:, t] = forward[:, t] * backward
        gamma *= times[:, None, None]
        return gamma[:, 0].sum(axis=0), steps * self.step, gamma, float(np.log(scale).sum(axis=1) @ times)

    def paths(self, sentences: list[list[str]]) -> list[list[str]]:
        """Most likely tags; of equal paths the one with the tag named first in TAGS, from the end on."""
        out: list[list[str]] = [[] for _ in sentences]
        with np.errstate(divide="ignore"):
            start, step, emit = (np.maximum(np.log(x), -1e4) for x in (self.start, self.step, self.emit))
        for rows, ids in same_length([self.ids(s) for s in sentences]):
            seen = emit[ids]
            best, back = start + seen[:, 0], []
            for t in range(1, seen.shape[1]):
                all_ways = best[:, :, None] + step
                back.append(all_ways.argmax(axis=1))
                best = np.take_along_axis(all_ways, back[-1][:, None, :], axis=1)[:, 0] + seen[:, t]
            tag = best.argmax(axis=1)
            path = [tag]
            for b in reversed(back):
                tag = b[np.arange(len(tag)), tag]
                path.append(tag)
            for row, found in zip(rows, np.stack(path[::-1], axis=1).tolist(), strict=True):
                out[row] = [TAGS[k] for k in found]
        return out


def same_length(ids: list[list[int]]) -> Iterator[tuple[list[int], np.ndarray]]:
    """Row numbers and ids of the rows of each length but 0."""
    by: dict[int, list[int]] = {}
    for row, x in enumerate(ids):
        by.setdefault(len(x), []).append(row)
    for size, rows in sorted(by.items()):
        if size:
            yield rows, np.array([ids[r] for r in rows])


def first_model(counts: dict[str, int]) -> Tagger:
    """Even starts and steps; emissions by the prior tags of the symbols and their counts."""
    names, k = [*CLASSES, *sorted(counts.keys() - set(CLASSES))], len(TAGS)
    emit = np.array([prior(s) * max(counts.get(s, 0), 1e-6) for s in names])
    return Tagger({s: i for i, s in enumerate(names)}, np.full(k, 1 / k), np.full((k, k), 1 / k), emit / np.maximum(emit.sum(axis=0), 1e-300))


def train_tagger(texts: DataFrame, column: str, vocabulary: int = VOCABULARY, rounds: int = ROUNDS) -> Tagger:
    """A tagger of the texts in a column; null texts and texts without tokens teach nothing.

    The `vocabulary` most frequent symbols are kept (ties by the smaller one), rarer ones share the classes of rare(). All
    texts are read in every round, a text that occurs several times once, with its number. likelihood has the log likelihood before each round.
    """
    distinct = texts.groupBy(F.col(column).alias("text")).agg(F.count(F.lit(1)).alias("n"))
    sentences = shared_table(spread(distinct.filter("text is not null")).select(symbols(tokenize(F.col("text"), lower=False)).alias("s"), "n").filter("size(s) > 0"), "sentences")
    frequent = sentences.select(F.explode("s").alias("s"), "n").groupBy("s").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "s").limit(vocabulary)
    model = first_model({r["s"]: r["n"] for r in frequent.collect()})  # bounded by the vocabulary

    def encode(batches: Iterator[pa.RecordBatch], model: Tagger = model) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([model.ids(s) for s in batch.column(0).to_pylist()], pa.list_(pa.int32())), batch.column(1)], names=["ids", "n"])

    encoded = shared_table(sentences.mapInArrow(encode, "ids array<int>, n long"), "encoded")
    k, v = len(TAGS), len(model.emit)
    for _ in range(rounds):

        def count(batches: Iterator[pa.RecordBatch], model: Tagger = model) -> Iterator[pa.RecordBatch]:
            start, steps, emit, total = np.zeros(k), np.zeros((k, k)), np.zeros((v, k)), 0.0
            for batch in batches:
                times = batch.column(1).to_numpy().astype(float)
                for rows, ids in same_length(batch.column(0).to_pylist()):
                    s, t, gamma, likelihood = model.expected(ids, times[rows])
                    start, steps, total = start + s, steps + t, total + likelihood
                    np.add.at(emit, ids.ravel(), gamma.reshape(-1, k))
            every = np.concatenate([[total], start, steps.ravel(), emit.ravel()])
            at = np.flatnonzero(every)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(every[at])], names=["at", "value"])

        sums = np.zeros(1 + k + k * k + v * k)
        got = encoded.mapInArrow(count, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()  # bounded by the model
        sums[got.column("at").to_numpy()] = got.column("value").to_numpy()
        model.likelihood.append(float(sums[0]))
        start, steps, emit = sums[1 : 1 + k], sums[1 + k : 1 + k + k * k].reshape(k, k), sums[1 + k + k * k :].reshape(v, k)
        unseen = emit.sum(axis=1) == 0
        emit = np.where(unseen[:, None], model.emit * 1e-9, emit)
        over = lambda x, axis: x / np.maximum(x.sum(axis=axis, keepdims=True), 1e-300)
        if start.sum():
            model = Tagger(model.number, over(start, 0), over(steps, 1), over(emit, 0), model.likelihood)
    return model


def tags(tokens: Column, tagger: Tagger) -> Column:
    """Tags of an array of tokens in their own case; null for null."""

    @F.pandas_udf("array<string>")
    def tagged(sentences: pd.Series) -> pd.Series:
        there = sentences.notna()
        found = iter(tagger.paths([list(s) for s in sentences[there]]))
        return pd.Series([next(found) if x else None for x in there], index=sentences.index, dtype=object)

    return tagged(symbols(tokens))


def train_on_pairs(pairs: DataFrame, vocabulary: int = VOCABULARY, rounds: int = ROUNDS) -> Tagger:
    """A tagger of all questions of a pair table."""
    return train_tagger(pairs.select(F.explode(F.array(q_text("question1", ""), q_text("question2", ""))).alias("text")), "text", vocabulary, rounds)


def noun_tagger(tagger: Tagger):
    """Column -> Column for lexical.match_features: the lower-case nouns of a text, with repeats."""

    def nouns(text: Column) -> Column:
        tokens = tokenize(text, lower=False)
        both = F.arrays_zip(tokens.alias("word"), tags(tokens, tagger).alias("tag"))
        return F.transform(F.filter(both, lambda x: F.startswith(x["tag"], F.lit("N"))), lambda x: F.lower(x["word"]))

    return nouns
