"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Character 1- to 3-grams of the lower-cased whole text (each run of non-letters is one space)
are hashed into BUCKETS features. Document frequencies come from all learning rows, in one
pre-aggregated pass. The weights are fitted with follow-the-regularised-leader proximal
steps under L1 and L2 penalties on a bounded, hash-chosen sample of labelled rows; the
softmax is then calibrated with one temperature on sampled rows kept out of the fit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from pairloom.llm.common import free_name, tidy

BUCKETS = 1 << 14
#: Bound of the fit: about this many labelled rows of each language (the hash decides which).
SAMPLE_PER_LANG = 1200
EPOCHS, ALPHA, BETA, L1, L2 = 4, 0.5, 1.0, 2e-4, 1e-4
UNKNOWN = "und"
NO_LETTER = re.compile(r"[\W\d_]+")
_MULTIPLIERS, _SHIFT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32), np.uint32(15)


def ngram_counts(text: str, buckets: int = BUCKETS) -> np.ndarray | None:
    """Hashed 1- to 3-gram counts of a whole text (buckets: a power of two); None where it has no letter."""
    body = NO_LETTER.sub(" ", text.lower()).strip()
    if not body:
        return None
    shift = np.uint32(33 - buckets.bit_length())
    out = np.zeros(buckets, np.int64)
    step = 1 << 20
    for at in range(0, len(body), step):  # blocks with an overlap of two, so memory is bounded
        block = (" " if at == 0 else "") + body[max(0, at - 2) : at + step] + (" " if at + step >= len(body) else "")
        codes = np.frombuffer(block.encode("utf-32-le", "surrogatepass"), "<u4")
        lead = 0 if at == 0 else 2  # windows that end in the overlap were counted with the block before
        one = codes * _MULTIPLIERS[0]
        two = (one[:-1] ^ (one[:-1] >> _SHIFT)) * _MULTIPLIERS[1] + codes[1:]
        three = (two[:-1] ^ (two[:-1] >> _SHIFT)) * _MULTIPLIERS[1] + codes[2:]
        grams = np.concatenate((one[lead:], two[max(0, lead - 1) :] * _MULTIPLIERS[2], three * _MULTIPLIERS[0]))
        out += np.bincount(grams >> shift, minlength=buckets)
    return out


@dataclass
class LanguageModel:
    """Languages in order, idf by bucket, weights bucket x language, bias and temperature."""

    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def features(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices and l2-normalised tf-idf values."""
        at = np.flatnonzero(counts)
        return self.weighted(at, counts[at])

    def weighted(self, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = (1.0 + np.log(n)) * self.idf[at]
        norm = float(np.sqrt((x * x).sum()))
        return at, (x / (norm or 1.0)).astype(np.float32)

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        at, x = self.features(counts)
        return softmax((x @ self.weights[at] + self.bias) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, langs: int, buckets: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by FTRL-proximal with elastic-net penalties; most weights stay exactly 0."""
    n, z, w = (np.zeros((buckets + 1, langs)) for _ in range(3))  # the last row is the bias
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            at = np.append(at, buckets)
            x = np.append(x, 1.0)
            zi, ni = z[at], n[at]
            shrunk = np.sign(zi) * np.maximum(np.abs(zi) - L1 * len(rows) / 1000, 0.0)
            wi = -shrunk / ((BETA + np.sqrt(ni)) / ALPHA + L2)
            p = softmax(x @ wi)
            p[labels[i]] -= 1.0
            g = x[:, None] * p[None, :]
            g2 = g * g
            z[at] += g - (np.sqrt(ni + g2) - np.sqrt(ni)) / ALPHA * wi
            n[at] += g2
    shrunk = np.sign(z) * np.maximum(np.abs(z) - L1 * len(rows) / 1000, 0.0)
    w = -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)
    return w[:buckets], w[buckets]


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least negative log-likelihood on calibration rows."""
    best, at = np.inf, 1.0
    for t in np.geomspace(0.25, 20, 121):
        z = logits / t
        z = z - z.max(1, keepdims=True)
        loss = float(np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(len(z)), labels]))
        if loss < best:
            best, at = loss, float(t)
    return at


def _count_rows(batch_iter: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """One partial document-frequency vector for each task."""
    df, docs = np.zeros(buckets, np.int64), 0
    for batch in batch_iter:
        for x in batch.column(0):
            c = ngram_counts(x.as_py() or "", buckets)
            if c is not None:
                df += c > 0
                docs += 1
    yield pa.RecordBatch.from_arrays([pa.array([docs], pa.int64()), pa.array([df], pa.list_(pa.int64()))], names=["docs", "df"])


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", buckets: int = BUCKETS, per_lang: int = SAMPLE_PER_LANG) -> LanguageModel | None:
    """Fit on labelled rows (null labels are left out); None where no row can be learned from.

    What reaches the driver is bounded: a row count for each language, one summed frequency
    vector, and hashed counts of about per_lang rows for each language. The sample is chosen
    by a hash of the key, so it is the same in every run and grows with per_lang only.
    """
    rows = labelled.filter(F.col(lang).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    counts = {r["lang"]: r["n"] for r in rows.filter(F.length(F.trim("text")) > 0).groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    langs = sorted(counts)
    # the uniform share of the hash space that keeps about per_lang rows of the language
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, per_lang / counts[k])))])
    uniform = F.pmod(F.xxhash64("key", F.lit("langid")), F.lit(1_000_000)) / 1_000_000
    schema = "key bigint, lang string, at array<int>, n array<float>"

    @tidy
    def sparse(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out: list[list] = [[], [], [], []]
            for k, g, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                c = ngram_counts(x.as_py() or "", buckets)
                if c is not None:
                    at = np.flatnonzero(c)
                    for o, v in zip(out, (k, g, at.astype(np.int32), c[at].astype(np.float32)), strict=True):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.list_(pa.int32())), pa.array(out[3], pa.list_(pa.float32()))], names=["key", "lang", "at", "n"])

    sample = rows.filter(uniform < share[F.col("lang")]).select("key", "lang", "text").mapInArrow(sparse, schema).toPandas().sort_values("key", kind="stable")
    parts = rows.select("text").mapInArrow(tidy(lambda it: _count_rows(it, buckets)), "docs bigint, df array<bigint>")
    summed = parts.select("docs", F.posexplode("df").alias("bucket", "df")).groupBy("bucket").agg(F.sum("docs").alias("docs"), F.sum("df").alias("df")).toPandas()
    if sample.empty or summed.empty:
        return None
    total = int(summed["docs"].iloc[0])
    df = np.zeros(buckets)
    df[summed["bucket"].to_numpy()] = summed["df"].to_numpy()
    model = LanguageModel(langs, np.log((1 + total) / (1 + df)) + 1, np.zeros((buckets, len(langs))), np.zeros(len(langs)))
    xs, ys = [], []
    for g, at, n in zip(sample["lang"], sample["at"], sample["n"], strict=True):
        xs.append(model.weighted(np.asarray(at, np.int32), np.asarray(n, np.float32)))
        ys.append(langs.index(g))
    del sample
    y = np.array(ys)
    calibrating = np.arange(len(xs)) % 5 == 4 if len(xs) >= 50 else np.zeros(len(xs), bool)
    fit = np.flatnonzero(~calibrating)
    model.weights, model.bias = fit_ftrl([xs[i] for i in fit], y[fit], len(langs), buckets)
    kept = np.flatnonzero(calibrating)
    if len(kept):
        logits = np.array([xs[i][1] @ model.weights[xs[i][0]] + model.bias for i in kept])
        model.temperature = fit_temperature(logits, y[kept])
    return model


def predict(docs: DataFrame, model: LanguageModel | None, text: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Add lang_pred and score (the calibrated probability) to every row, from its whole text.

    Null texts, texts without a letter and any text where nothing could be learned get "und"
    and score 0. The columns in keep (all, if None) are returned before the two, which get underscores
    put before them where a kept column has their name. Equal probabilities go to the language that
    sorts first. Repeated rows are predicted each; an empty table gives no rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # buckets x languages numbers, whatever the table's size
    kept = list(docs.columns if keep is None else keep)
    new = [free_name(kept, n) for n in names]
    chosen = docs.select(*kept) if text in kept else docs.select(*kept, F.col(text))
    at = chosen.columns.index(text)
    out = StructType([docs.schema[n] for n in kept] + [StructField(new[0], StringType()), StructField(new[1], DoubleType())])

    @tidy
    def label(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in it:
            langs, scores = [], []
            for x in batch.column(at):
                c = ngram_counts(x.as_py() or "", len(m.idf)) if m is not None else None
                if c is None:
                    langs.append(UNKNOWN), scores.append(0.0)
                else:
                    p = m.probabilities(c)
                    best = int(p.argmax())
                    langs.append(m.langs[best]), scores.append(float(min(1.0, p[best])))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*kept, *new])

    return chosen.mapInArrow(label, out)
