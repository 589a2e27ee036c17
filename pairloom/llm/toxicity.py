"""Toxicity scores: Levenshtein automata intersected with a lexicon trie, and context windows.

The lexicon is learned from labelled rows: words, and stems of four to seven letters, that
occur in many different toxic texts and almost no other (near copies of one text count once,
told by many minima of their shingles). The terms form a trie; its product with
the Levenshtein automaton of each term's allowed distance is made deterministic as words are
read, so a word costs one table lookup a letter and dies early. Every hit is looked at in its
window: inside quotation marks or beside a reporting word it counts as quoted, else as abuse.
A logistic model over the hit counts, fitted on a bounded sample, gives the score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from pairloom.llm.common import free_name, materialize, tidy
from pairloom.llm.linking import smallest_labels
from pairloom.llm.ngramjoin import shingles_of

#: Bound of the fit: about this many labelled rows of each class (a hash decides which).
SAMPLE_PER_CLASS = 3000
#: Near copies among them: so many minima over shingles of so many words, and the share that agrees.
COPY_MINIMA, COPY_WIDTH, COPY_SHARE = 128, 5, 0.8
STEMS = (4, 5, 6, 7)
TOKEN = re.compile(r"[^\W_]+(?:[*@$][^\W_]+)*")
KEPT_STEPS = 400_000  # letters of states that a worker remembers
WINDOW = 40  # characters to each side of a hit
# Quotation marks, and words that report what someone else said.
OPENING, CLOSING = "\"“„«‹‘", "\"”“»›’"
REPORTING = frozenset("said says wrote called calls quote quoted quotes word words term slur insult insults reported dit écrit mot terme insulte sagte schrieb wort begriff zitat dijo escribió palabra término cita".split())
# Prior means of the weights (abuse exact, abuse misspelled, abuse stem, quoted, share, bias), used where labels say little.
PRIOR, PRIOR_STRENGTH = np.array([2.0, 1.5, 2.0, 0.3, 0.5, -2.5]), 1.0


def allowed(length: int, stem: bool) -> int:
    """Edits allowed for a term of so many letters."""
    return int(length >= 6) if stem else int(length >= 5) + int(length >= 9)


class TermAutomaton:
    """The lexicon trie x Levenshtein product, made deterministic on demand."""

    def __init__(self, words: list[str], stems: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.word_at: dict[int, int] = {}  # node -> edits allowed for the word that ends there
        self.stem_at: dict[int, int] = {}
        self.most = [0]  # edits allowed by some term below the node
        for terms, ends, stem in ((words, self.word_at, False), (stems, self.stem_at, True)):
            for term in terms:
                k, node = allowed(len(term), stem), 0
                self.most[0] = max(self.most[0], k)
                for c in term:
                    if c not in self.children[node]:
                        self.children[node][c] = len(self.children)
                        self.children.append({})
                        self.most.append(0)
                    node = self.children[node][c]
                    self.most[node] = max(self.most[node], k)
                ends[node] = k
        self._begin()

    def _begin(self) -> None:
        """No state but the first is known; the others are made again as words need them."""
        self.states: dict[frozenset, int] = {}
        self.sets: list[dict[int, int]] = []
        self.steps: list[dict[str, int]] = []
        self.verdict: list[int | None] = []
        self.stemmed: list[int | None] = []
        self.known = 0
        self.start = self._state(self._closure({0: 0}))

    def _closure(self, at: dict[int, int]) -> dict[int, int]:
        """Adds nodes reached by leaving out letters of the term; drops nodes beyond their allowance."""
        work = list(at)
        while work:
            node = work.pop()
            e = at[node] + 1
            for child in self.children[node].values():
                if e <= self.most[child] and e < at.get(child, 99):
                    at[child] = e
                    work.append(child)
        return {n: e for n, e in at.items() if e <= self.most[n]}

    def _state(self, at: dict[int, int]) -> int:
        key = frozenset(at.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(at)
            self.steps.append({})
            words = [e for n, e in at.items() if e <= self.word_at.get(n, -1)]
            stems = [e for n, e in at.items() if e <= self.stem_at.get(n, -1)]
            self.verdict.append(min(words) if words else None)
            self.stemmed.append(min(stems) if stems else None)
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        out: dict[int, int] = {}

        def add(node: int, e: int) -> None:
            if e <= self.most[node] and e < out.get(node, 99):
                out[node] = e

        for node, e in self.sets[state].items():
            add(node, e + 1)
            for letter, child in self.children[node].items():
                add(child, e + (letter != c))
        to = self.steps[state][c] = self._state(self._closure(out))
        self.known += 1
        return to

    def match(self, word: str) -> tuple[int, bool] | None:
        """(edits, whether by a stem) of the best term for a lower-case word; None where none is near."""
        if self.known >= KEPT_STEPS:
            self._begin()
        state, stem = self.start, None
        for c in word:
            nxt = self.steps[state].get(c)
            state = self._step(state, c) if nxt is None else nxt
            if not self.sets[state]:
                break
            s = self.stemmed[state]
            if s is not None and (stem is None or s < stem):
                stem = s
        else:
            whole = self.verdict[state]
            if whole is not None and (stem is None or whole <= stem):
                return whole, False
        return None if stem is None else (stem, True)


@dataclass
class ToxicityModel:
    words: list[str]
    stems: list[str]
    exempt: frozenset[str]
    weights: np.ndarray
    hits: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.words, self.stems, self.exempt, self.weights

    def __setstate__(self, state):
        self.words, self.stems, self.exempt, self.weights = state
        self.hits = {}

    def automaton(self) -> TermAutomaton:
        if "automaton" not in self.hits:
            self.hits["automaton"] = TermAutomaton(self.words, self.stems)
        return self.hits["automaton"]

    def features(self, text: str) -> np.ndarray:
        """log counts of exact, misspelled, stem and quoted hits, hits per 100 words, and 1."""
        body = text.lower()
        tokens = TOKEN.findall(body)
        match = self.automaton().match
        known = {w: m for w in set(tokens) if (m := match(w)) is not None and (m[0] == 0 or w not in self.exempt)}
        counts = [0, 0, 0, 0]
        if known:
            for x in TOKEN.finditer(body):
                m = known.get(x[0])
                if m is not None:
                    counts[3 if quoted(body, x.start(), x.end()) else 2 if m[1] else int(m[0] > 0)] += 1
        return np.array([*np.log1p(counts), np.log1p(100 * sum(counts) / max(1, len(tokens))), 1.0])

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.features(text) @ self.weights, -30, 30))))


def quoted(text: str, start: int, end: int) -> bool:
    """Whether the window around text[start:end] shows a quotation or a report."""
    before, after = text[max(0, start - WINDOW) : start], text[end : end + WINDOW]
    opened = max((before.rfind(c) for c in OPENING), default=-1)
    if opened >= 0 and "\n" not in before[opened:] and any(c in after.split("\n")[0] for c in CLOSING):
        inside = before[opened + 1 :]
        if not any(c in inside for c in CLOSING):
            return True
    near = TOKEN.findall(before)[-3:] + TOKEN.findall(after)[:2]
    return any(w in REPORTING for w in near)


def fit_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton steps for a logistic model with a Gaussian prior around PRIOR; classes weigh the same."""
    w = PRIOR.copy()
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + PRIOR_STRENGTH * (w - PRIOR)
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + PRIOR_STRENGTH * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def copy_classes(texts: DataFrame) -> DataFrame:
    """(text_id, copy) of each distinct text from (text_id, words); texts are those of the bounded sample.

    Only the sketches, of COPY_MINIMA numbers a text, reach the driver, where each pair is compared.
    """
    rng = np.random.default_rng(42)
    factors, shifts = rng.integers(0, 1 << 63, (2, COPY_MINIMA)).astype(np.uint64)
    factors |= np.uint64(1)

    @tidy
    def sketch(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = []
            for x in batch.column(1):
                shingles = shingles_of(x.as_py(), COPY_WIDTH)
                minima = [int(((shingles * f + s) >> np.uint64(32)).min()) for f, s in zip(factors, shifts, strict=True)]
                rows.append(np.array(minima, "<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["text_id", "sketch"])

    distinct = texts.dropDuplicates(["text_id"]).select("text_id", F.array_join("words", " ").alias("text"))
    got = sorted((r["text_id"], bytes(r["sketch"])) for r in distinct.mapInArrow(sketch, "text_id bigint, sketch binary").collect())
    ids = np.array([i for i, _ in got], np.int64)
    sketches = np.frombuffer(b"".join(x for _, x in got), "<u4").reshape(len(got), COPY_MINIMA)
    # each text is tied to itself, so that all have a class
    a, b = [ids], [ids]
    for i in range(len(ids)):
        near = ids[i + 1 :][(sketches[i + 1 :] == sketches[i]).sum(1) >= COPY_SHARE * COPY_MINIMA]
        a.append(np.full(len(near), ids[i])), b.append(near)
    items, label = smallest_labels(np.concatenate(a), np.concatenate(b))
    return texts.sparkSession.createDataFrame(list(zip(items.tolist(), label.tolist(), strict=True)), "text_id bigint, copy bigint")


def lexicon(sample: DataFrame, min_share: float = 0.02, least: int = 6, odds: float = 40.0) -> tuple[list[str], list[str], frozenset[str]]:
    """Words and stems of toxic texts from (text, toxic) rows, by the distinct texts that hold them,
    and the words of other texts that merely look like a term.

    Near copies are texts that agree in COPY_SHARE of their COPY_MINIMA minima over shingles of
    COPY_WIDTH words, and chains of such texts. A class of copies counts once, any other text
    by itself. A term needs `least` toxic texts and a share of them, and `odds` times as many
    as there are other texts with it.
    """
    # equal word sequences are one text, named by their hash
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1)
    texts = sample.select("toxic", words.alias("words")).filter(F.size("words") > 0).withColumn("text_id", F.xxhash64("words"))
    texts = texts.join(F.broadcast(copy_classes(texts)), "text_id").select("toxic", "copy", F.array_distinct("words").alias("words"))
    bad_texts = texts.filter("toxic = 1").select("copy").distinct().count()
    least = max(least, round(min_share * bad_texts))
    seen = texts.select("toxic", "copy", F.explode("words").alias("word")).distinct()
    by_word = seen.groupBy("word").agg(F.sum((F.col("toxic") == 1).cast("int")).alias("bad"), F.sum((F.col("toxic") == 0).cast("int")).alias("good"))
    by_word = materialize(by_word, "words")
    keep = (F.col("bad") >= least) & (F.col("bad") >= odds * F.col("good"))
    whole = [r["word"] for r in by_word.filter(keep & (F.length("word") >= 3)).select("word").collect()]
    stems = (
        by_word.select("word", "bad", "good", F.explode(F.array(*[F.when(F.length("word") > n, F.substring("word", 1, n)) for n in STEMS])).alias("stem"))
        .filter(F.col("stem").isNotNull()).groupBy("stem")
        .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.sum((F.col("bad") > 0).cast("int")).alias("forms"))
        .filter((F.col("bad") >= 3 * least) & (F.col("bad") >= odds * F.col("good")) & (F.col("forms") >= 4))
    )
    found = {r["stem"]: r["bad"] for r in stems.collect()}
    # of nested stems the longest that keeps nearly all texts of the shortest
    chosen = set()
    for stem in sorted(found, key=len):
        if not any(stem[:n] in found for n in range(1, len(stem))):
            best = stem
            while longer := [s for s in found if len(s) == len(best) + 1 and s.startswith(best) and found[s] >= 0.9 * found[stem]]:
                best = longer[0]
            chosen.add(best)
    words, stems = sorted(w for w in whole if not any(w.startswith(s) for s in chosen)), sorted(chosen)

    @tidy
    def alike(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = TermAutomaton(words, stems).match
        for batch in it:
            yield pa.RecordBatch.from_arrays([pa.array([w for w in batch.column(0).to_pylist() if (m := match(w)) and m[0]], pa.string())], names=["word"])

    clean = by_word.filter((F.col("good") > 0) & (F.col("bad") < odds * F.col("good"))).select("word")
    exempt = frozenset(r["word"] for r in clean.mapInArrow(alike, "word string").collect())
    return words, stems, exempt


def train(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", per_class: int = SAMPLE_PER_CLASS) -> ToxicityModel:
    """Fit on about per_class labelled documents of each class, chosen by a hash of the key.

    Null labels, and labels without a document, are left out. The sampled keys (bounded by
    per_class) go to every task, so only the texts of the sample move; of these, the lexicon
    (terms over fixed thresholds) and one short feature vector a row reach the driver. Without
    labelled rows the model is the prior with no terms.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(label).cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return ToxicityModel([], [], frozenset(), PRIOR.copy())
    uniform = F.pmod(F.xxhash64("key", F.lit("toxicity")), F.lit(1_000_000)) / 1_000_000
    share = F.when(F.col("toxic") == 1, min(1.0, per_class / counts.get(1, 1))).otherwise(min(1.0, per_class / counts.get(0, 1)))
    chosen = F.broadcast(known.filter(uniform < share))
    texts = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sample = materialize(texts.join(chosen, "key"), "labelled")
    model = ToxicityModel(*lexicon(sample), PRIOR.copy())
    names = [f"x{i}" for i in range(len(PRIOR))]

    @tidy
    def measure(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x = np.array([model.features(t.as_py() or "") for t in batch.column(1)]).reshape(-1, len(PRIOR))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *[pa.array(x[:, i]) for i in range(len(PRIOR))]], names=["key", "toxic", *names])

    got = sample.select("key", "text", "toxic").mapInArrow(measure, "key bigint, toxic int, " + ", ".join(f"{n} double" for n in names)).toPandas()
    got = got.sort_values("key", kind="stable")
    model.weights = fit_logistic(got[names].to_numpy(), got["toxic"].to_numpy())
    return model


def score(docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns in keep, score (0 to 1) and predicted (score >= 0.5) of every whole text.

    Null and empty texts have no hit and get the model's base score. Repeated rows are scored
    each; an empty table gives no rows. score and predicted get underscores put before them where
    a kept column has their name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the lexicon and six weights
    cols = list(dict.fromkeys([key, *keep]))
    new = [free_name(cols, n) for n in ("score", "predicted")]
    chosen = docs.select(*cols) if text in cols else docs.select(*cols, F.col(text))
    at = chosen.columns.index(text)
    out = StructType([docs.schema[n] for n in cols] + [StructField(new[0], DoubleType()), StructField(new[1], IntegerType())])

    @tidy
    def measure(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in it:
            s = [m.score(t.as_py() or "") for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(cols)], pa.array(s, pa.float64()), pa.array([int(v >= 0.5) for v in s], pa.int32())], names=[*cols, *new])

    return chosen.mapInArrow(measure, out)
