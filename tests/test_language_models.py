"""The learned tagger and lemmatiser against plain loops, and on planted languages."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.operators import alignment, lexical, paradigms, tagging, vector_features

PAIRS = "pair_id bigint, question1 string, question2 string, is_duplicate int, split string"


def plain_counts(model, ids):
    """Forward-backward of one sentence in plain probabilities."""
    k, emit, step = len(tagging.TAGS), model.emit, model.step
    f = [[model.start[j] * emit[ids[0]][j] for j in range(k)]]
    for t in ids[1:]:
        f.append([sum(f[-1][i] * step[i][j] for i in range(k)) * emit[t][j] for j in range(k)])
    b = [[1.0] * k]
    for t in reversed(ids[1:]):
        b.insert(0, [sum(step[i][j] * emit[t][j] * b[0][j] for j in range(k)) for i in range(k)])
    total = sum(f[-1])
    gamma = [[x * y / total for x, y in zip(p, q, strict=True)] for p, q in zip(f, b, strict=True)]
    steps = [[sum(f[t][i] * step[i][j] * emit[ids[t + 1]][j] * b[t + 1][j] for t in range(len(ids) - 1)) / total for j in range(k)] for i in range(k)]
    return gamma, steps, math.log(total)


def best_path(model, ids):
    """The best path by trying all tags of weight."""
    def go(t, tag, score):
        if t == len(ids):
            return score, ()
        ways = []
        for j in range(len(tagging.TAGS)):
            p = (model.start[j] if t == 0 else model.step[tag][j]) * model.emit[ids[t]][j]
            if p > 0:
                s, path = go(t + 1, j, score + math.log(p))
                ways.append((s, (j, *path)))
        return max(ways, default=(-math.inf, ()))

    return go(0, None, 0.0)[0]


@pytest.fixture(scope="module")
def trained(spark):
    rng = random.Random(1)
    nouns, verbs, adjectives = ([f"{w}{e}" for w in words.split()] for words, e in (("dog cat house tree car", ""), ("walk jump play", "ing"), ("loc fin norm", "al")))
    texts = [(f"the {rng.choice(adjectives)} {rng.choice(nouns)} is {rng.choice(verbs)} in {rng.choice(nouns)} 7 ?",) if rng.random() < 0.8 else (f"we saw Anna {rng.choice(verbs)}",) for _ in range(300)] + [("",), (None,)]
    df = spark.createDataFrame(texts, "text string").repartition(5)
    return df, tagging.train_tagger(df, "text", rounds=5)


def test_likelihood_rises(trained):
    _, model = trained
    assert len(model.likelihood) == 5 and all(b > a for a, b in zip(model.likelihood, model.likelihood[1:], strict=False))
    assert np.allclose(model.start.sum(), 1) and np.allclose(model.step.sum(axis=1)[model.step.sum(axis=1) > 0], 1)


@pytest.mark.parametrize("rounds", [0, 5])
def test_counts_and_paths_match_loops(trained, rounds):
    df, model = trained
    sentences = [s.split() for s in ("the local dog is walking in house 7 ?", "we saw ^anna jumping", "the final car is playing in cat 7 ?")]
    if not rounds:  # every step is possible before the first round
        model = tagging.train_tagger(df, "text", rounds=0)
        sentences += [["dog"], ["never", "seen", "words"], ["the", "of", "^x", "y", "?"]]
    for s in sentences:
        ids = model.ids(s)
        start, steps, gamma, total = model.expected(np.array([ids]))
        g, plain, log = plain_counts(model, ids)
        assert np.allclose(gamma[0], g) and np.allclose(start, g[0]) and np.allclose(steps, plain) and total == pytest.approx(log)
    for s, path in zip(sentences, model.paths(sentences), strict=True):
        ids, tags = model.ids(s), [tagging.TAGS.index(x) for x in path]
        score = math.log(model.start[tags[0]] * model.emit[ids[0]][tags[0]]) + sum(math.log(model.step[a][b] * model.emit[i][b]) for a, b, i in zip(tags, tags[1:], ids[1:], strict=False))
        assert score == pytest.approx(best_path(model, ids))


def test_one_round_is_the_sum_of_all_sentences(spark):
    texts = ["a dog walking", "Anna saw the house", "a dog walking"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    first, second = tagging.train_tagger(df, "text", rounds=0), tagging.train_tagger(df, "text", rounds=1)
    symbols = [[w.lower() if i == 0 or w[0].islower() else "^" + w.lower() for i, w in enumerate(t.split())] for t in texts]
    found = [plain_counts(first, first.ids(s)) for s in symbols]
    start = np.sum([g[0] for g, _, _ in found], axis=0)
    steps = np.sum([x for _, x, _ in found], axis=0)
    assert np.allclose(second.start, start / start.sum()) and second.likelihood == pytest.approx([sum(x for _, _, x in found)])
    rows = steps.sum(axis=1) > 1e-12
    assert np.allclose(second.step[rows], (steps / np.maximum(steps.sum(axis=1, keepdims=True), 1e-300))[rows])


def test_tags_of_texts(spark, trained):
    _, model = trained
    df = spark.createDataFrame([("the local dog is playing in house 7 ?",), ("",), (None,)], "text string")
    rows = df.select(tagging.tags(tagging.tokenize(F.col("text"), lower=False), model).alias("t")).collect()
    assert rows[0]["t"] == ["DT", "JJ", "NN", "VB", "VB", "IN", "NN", "CD", "."] and rows[1]["t"] == [] and rows[2]["t"] is None


def test_features_take_the_tagger(spark, trained):
    _, model = trained
    pairs = spark.createDataFrame([(1, "the local dog is walking in house 7 ?", "the final dog is playing in tree 7 ?", 1, "train"), (2, None, "", 0, "test")], PAIRS)
    got = {r["pair_id"]: r for r in lexical.match_features(pairs, tagging.noun_tagger(model)).collect()}
    assert got[1]["noun_match_count"] == 1 and got[1]["noun_match_ratio"] == 0.25
    aligned = {r["pair_id"]: r for r in alignment.alignment_features(alignment.annotated_by(pairs, model)).collect()}
    assert aligned[1]["S_unmatch_num"] == 0.0 and 0 < aligned[1]["sem_sim"] < 1 and len(aligned) == 2
    assert tagging.train_on_pairs(pairs.limit(0), rounds=2).likelihood == [0.0, 0.0]


STEMS = [f"{a}{b}{c}" for a in "bdgklm" for b in "aeo" for c in ("rt", "nd", "lk")]

OTHERS = [f"{a}{b}{c}" for a in "pstv" for b in "iu" for c in ("mp", "lt")]


def test_planted_paradigms_are_found(spark):
    """walk, walks, walking, walked; and -ies for -y, of which the longer ending wins over -s."""
    words = [(s + e, n) for s in STEMS for e, n in (("", 9), ("s", 3), ("ing", 2), ("ed", 2))] + [(s + e, n) for s in OTHERS for e, n in (("y", 8), ("ies", 4))]
    words += [("king", 5), ("red", 5), ("is", 9), ("x1", 2), ("été", 3), ("ab", 1)]
    df = spark.createDataFrame(words, "word string, n bigint")
    rules = paradigms.mined(df)
    assert (rules["s"], rules["ing"], rules["ed"], rules["ies"]) == ("", "", "", "y") and "" not in rules
    got = {r["word"]: r["lemma"] for r in paradigms.lemma_table(df, rules).collect()}
    assert got.keys() == {w for w, _ in words}
    assert all(got[s + e] == s for s in STEMS for e in ("", "s", "ing", "ed")) and all(got[s + "ies"] == s + "y" for s in OTHERS)
    assert all(got[w] == w for w in ("king", "red", "is", "x1", "été", "ab"))
    trie = paradigms.Lemmatiser(rules)
    known = {w for w, _ in words}
    assert all(trie(w, known.__contains__) == lemma for w, lemma in got.items())
    assert trie("newnouns") == "newnoun" and trie("sky") == "sky" and trie("") == ""
    assert paradigms.lemma_table(df, {}).filter("word <> lemma").count() == 0


def test_rules_match_loops(spark):
    rng = random.Random(3)
    words = {"".join(rng.choice("ab") for _ in range(rng.randrange(3, 9))): rng.randrange(1, 5) for _ in range(150)}
    df = spark.createDataFrame(sorted(words.items()), "word string, n bigint")
    stems: dict = {}
    for w in words:
        for k in range(max(paradigms.STEM, len(w) - paradigms.ENDING), len(w) + 1):
            stems.setdefault(w[k:], {})[w[:k]] = words[w]
    top = sorted(stems, key=lambda e: (-len(stems[e]), e))[:12]
    want = {}
    for e in top:
        ways = []
        for base in top:
            both = stems[e].keys() & stems[base].keys()
            n1, n2 = sum(stems[e][s] for s in both), sum(stems[base][s] for s in both)
            if e != base and len(both) >= 3 and (n2 > n1 or n2 == n1 and (len(base), base) < (len(e), e)):
                ways.append((-len(both), len(base), base))
        if ways:
            want[e] = min(ways)[2]
    assert paradigms.mined(df, 12, 3) == want and len(want) > 5


def test_lemma_distances_join_the_table(spark):
    pairs = spark.createDataFrame([(k, f"{STEMS[k % 27]}ing {STEMS[(k + 1) % 27]}s", f"{STEMS[k % 27]} {STEMS[(k + 1) % 27]}", 0, "train") for k in range(54)] + [(99, None, "", 0, "train")], PAIRS)
    got = {r["pair_id"]: r for r in vector_features.learned_lemma_distance_features(pairs).collect()}
    plain = {r["pair_id"]: r for r in vector_features.lemma_distance_features(pairs).collect()}
    assert len(got) == 55 and all(got[k]["1wl_tfidf_cosine"] == pytest.approx(0, abs=1e-6) for k in got) and plain[3]["1wl_tfidf_cosine"] == 1.0
