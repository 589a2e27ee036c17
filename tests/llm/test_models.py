"""The trained operators (1 and 8) against plain versions written out, and the long texts that all operators must take."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from pairloom.llm import collocations, divergence, langid, licenses, quality, toxicity


def plain_ftrl(rows, labels, langs, buckets, epochs, order):
    """Follow the regularised leader over dense lists, one weight at a time."""
    n, z = ([[0.0] * langs for _ in range(buckets + 1)] for _ in range(2))
    cut = langid.L1 * len(rows) / 1000

    def weight(i, k):
        if abs(z[i][k]) <= cut:
            return 0.0
        return -math.copysign(abs(z[i][k]) - cut, z[i][k]) / ((langid.BETA + math.sqrt(n[i][k])) / langid.ALPHA + langid.L2)

    for _ in range(epochs):
        for r in next(order):
            x = [*map(float, rows[r]), 1.0]
            now = [[weight(i, k) for k in range(langs)] for i in range(buckets + 1)]
            logits = [sum(x[i] * now[i][k] for i in range(buckets + 1)) for k in range(langs)]
            top = max(logits)
            e = [math.exp(v - top) for v in logits]
            p = [v / sum(e) for v in e]
            for i in range(buckets + 1):
                if x[i]:
                    for k in range(langs):
                        g = x[i] * (p[k] - (labels[r] == k))
                        z[i][k] += g - (math.sqrt(n[i][k] + g * g) - math.sqrt(n[i][k])) / langid.ALPHA * now[i][k]
                        n[i][k] += g * g
    return [[weight(i, k) for k in range(langs)] for i in range(buckets)], [weight(buckets, k) for k in range(langs)]


def test_ftrl_matches_a_dense_loop():
    rng = np.random.default_rng(5)
    buckets, langs = 12, 3
    dense = np.where(rng.random((60, buckets)) < 0.4, rng.random((60, buckets)), 0).astype(np.float32)
    labels = rng.integers(0, langs, 60)
    dense[np.arange(60), labels] += 1
    rows = [(np.flatnonzero(x), x[np.flatnonzero(x)]) for x in dense]

    def orders(seed=7):
        own = np.random.default_rng(seed)
        while True:
            yield own.permutation(60).tolist()

    w, b = langid.fit_ftrl(rows, labels, langs, buckets)
    want_w, want_b = plain_ftrl(dense.tolist(), labels.tolist(), langs, buckets, langid.EPOCHS, orders())
    assert np.allclose(w, want_w, atol=1e-6) and np.allclose(b, want_b, atol=1e-6) and np.count_nonzero(w)


def test_l1_leaves_weights_at_zero():
    rows = [(np.array([i % 3, 3 + i % 7]), np.array([1.0, 1e-8], np.float32)) for i in range(90)]
    w, _ = langid.fit_ftrl(rows, np.arange(90) % 3, 3, 16)
    assert not w[3:].any() and all(w[k].argmax() == k for k in range(3))


def test_temperature_is_the_best_of_a_grid():
    rng = np.random.default_rng(6)
    logits, labels = rng.normal(size=(200, 4)) * 9, rng.integers(0, 4, 200)

    def loss(t):
        return np.mean([math.log(sum(math.exp(v / t) for v in row)) - row[k] / t for row, k in zip(logits.tolist(), labels.tolist(), strict=True)])

    found = langid.fit_temperature(logits, labels)
    assert loss(found) <= min(loss(t) for t in np.geomspace(0.3, 19, 40)) + 1e-6 and found > 2


def test_counts_and_features_match_plain_ones():
    """Grams that differ share a bucket only by their hash: counts of grams add up to those of buckets."""
    rng = random.Random(7)
    for _ in range(40):
        text = "".join(rng.choice("abcé12 .\n") for _ in range(rng.randrange(1, 80)))
        found = langid.ngram_counts(text)
        body = re.sub(r"[\W\d_]+", " ", text.lower()).strip()
        if not body:
            assert found is None
            continue
        body = f" {body} "
        grams = Counter(body[i : i + k] for k in (1, 2, 3) for i in range(len(body) - k + 1))
        assert found.sum() == sum(grams.values())
        assert np.array_equal(found, sum(n * langid_gram(g) for g, n in grams.items()))
        model = langid.LanguageModel(["a"], np.arange(1, len(found) + 1) / 7, np.zeros((len(found), 1)), np.zeros(1))
        at, x = model.features(found)
        raw = [(1 + math.log(found[i])) * (i + 1) / 7 for i in at]
        assert np.allclose(x, np.array(raw) / math.sqrt(sum(v * v for v in raw)), atol=1e-6)


def langid_gram(gram):
    """The bucket of one gram, by counting a text that has it and what is left without it."""
    codes = np.array([ord(c) for c in gram], np.uint32)
    shift = np.uint32(33 - langid.BUCKETS.bit_length())
    h = codes[:1] * langid._MULTIPLIERS[0]
    for c in codes[1:]:
        h = (h ^ (h >> langid._SHIFT)) * langid._MULTIPLIERS[1] + c
    h = h * (np.uint32(1), langid._MULTIPLIERS[2], langid._MULTIPLIERS[0])[len(gram) - 1]
    return np.bincount(h >> shift, minlength=langid.BUCKETS)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1]


def plain_features(model, text):
    """Hits word by word, with plain edit distances to all terms and the windows as slices."""
    body = text.lower()
    found = list(re.finditer(r"[^\W_]+(?:[*@$][^\W_]+)*", body))
    counts = [0, 0, 0, 0]
    for m in found:
        w = m[0]
        whole = [e for t in model.words if (e := edits(w, t)) <= toxicity.allowed(len(t), False)]
        stems = [e for t in model.stems for k in range(len(w) + 1) if (e := edits(w[:k], t)) <= toxicity.allowed(len(t), True)]
        if not whole and not stems:
            continue
        by_stem = not whole or bool(stems) and min(stems) < min(whole)
        e = min(stems if by_stem else whole)
        if e and w in model.exempt:
            continue
        before, after = body[max(0, m.start() - 40) : m.start()], body[m.end() : m.end() + 40]
        at = max((i for i, c in enumerate(before) if c in toxicity.OPENING), default=None)
        quoted = at is not None and "\n" not in before[at:] and any(c in toxicity.CLOSING for c in after.split("\n")[0]) and not any(c in toxicity.CLOSING for c in before[at + 1 :])
        word = r"[^\W_]+(?:[*@$][^\W_]+)*"
        quoted = quoted or bool({*re.findall(word, before)[-3:], *re.findall(word, after)[:2]} & toxicity.REPORTING)
        counts[3 if quoted else 2 if by_stem else int(e > 0)] += 1
    return [*(math.log1p(c) for c in counts), math.log1p(100 * sum(counts) / max(1, len(found))), 1.0]


def test_toxicity_scores_match_plain_ones():
    rng = random.Random(8)
    model = toxicity.ToxicityModel(["grobnik", "zut", "plonkerish"], ["vermle", "skunk"], frozenset({"grobnix", "zuts"}), np.array([1.5, 1.0, 2.0, -0.5, 0.7, -2.0]))
    pool = ["grobnik", "Grobnick", "grobnix", "zut", "zuts", "plonkerish", "plonkrsh", "vermlein", "vermlings", "skunks", "skank", "said", "wrote", "the", "a", "“", "”", '"', "quote", "end.\n", "«", "»", "w*rd", "x" * 30]
    for _ in range(250):
        text = " ".join(rng.choice(pool) for _ in range(rng.randrange(0, 25)))
        want = plain_features(model, text)
        assert model.features(text) == pytest.approx(want), text
        assert model.score(text) == pytest.approx(1 / (1 + math.exp(-sum(x * w for x, w in zip(want, model.weights, strict=True)))))


def test_the_logistic_fit_is_a_minimum():
    rng = np.random.default_rng(9)
    x = np.column_stack([rng.random((120, 5)), np.ones(120)])
    y = (rng.random(120) < 0.3).astype(int)
    w = toxicity.fit_logistic(x, y)

    def loss(v):
        p = 1 / (1 + np.exp(-(x @ v)))
        weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() + toxicity.PRIOR_STRENGTH / 2 * ((v - toxicity.PRIOR) ** 2).sum()

    assert all(loss(w) <= loss(w + d * np.eye(6)[i]) + 1e-9 for i in range(6) for d in (-1e-3, 1e-3))


def test_lexicon_matches_plain_counts(spark):
    rng = random.Random(10)
    clean = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(10) for j in range(10)]
    rows = []
    for k in range(160):
        bad = k % 2
        w = rng.sample(clean, 25) + (["grobnik"] if bad and rng.random() < 0.6 else []) + (["mixed"] if rng.random() < 0.3 else []) + ([rng.choice(["vermleen", "vermlops", "vermlian", "vermlesk", "vermluse"])] if bad and rng.random() < 0.7 else [])
        rows.append((" ".join(w), bad))
    words, stems, exempt = toxicity.lexicon(spark.createDataFrame(rows, "text string, toxic int"))
    bad, good = (Counter(w for t, label in rows if label == k for w in set(t.split())) for k in (1, 0))
    least = max(6, round(0.02 * 80))
    want = {w for w in bad if bad[w] >= least and bad[w] >= 40 * good[w]}
    assert {w for w in want if not any(w.startswith(s) for s in stems)} == set(words) and "grobnik" in words and "mixed" not in words
    assert len(stems) == 1 and stems[0].startswith("verm") and not exempt & want


LONG = ["one line without an end " * 40_000, "x" * 1_500_000, "a\n" * 300_000, "under the mit license. " * 20_000, "é" * 400_000 + " end"]


@pytest.mark.parametrize("text", LONG, ids=lambda t: t[:8].strip())
def test_very_long_texts(spark, text):
    df = spark.createDataFrame([(1, text, "en", "s"), (2, None, None, None)], "doc_id bigint, text string, lang string, source string")
    n = len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text))
    got = {r["doc_id"]: r for r in licenses.scan_licenses(df).collect()}
    assert got[1]["n_words"] == n and got[1]["n_base"] == text.count("under the mit license") and got[2]["n_words"] == 0
    assert {r["n_words"] for r in quality.quality_rules(df).collect()} == {0, len(text.split())}
    assert divergence.source_divergence(df, min_docs=1).filter("part = 'pair'").count() == 0
    counts = {(r["lang"], r["phrase"]): r["f"] for r in collocations.phrase_counts(df, "text", "lang", 2, 10).collect()}
    assert counts.get(("en", ""), 0) == (len(text.split()) if len(text.split()) >= 10 else 0)
