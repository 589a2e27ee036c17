"""Alignment among similar words only, in one pass over the pairs."""

import random

import pyarrow as pa

from pairloom.operators import alignment


def test_only_words_with_a_common_key_are_compared(monkeypatch):
    rng, calls = random.Random(4), []
    words = ["walk", "walked", "walking", "house", "housing", "car", "auto", "big", "tree"]
    sentence = lambda n: [{"word": rng.choice(words), "pos": rng.choice(("NN", "VB", "JJ")), "deps": {}} for _ in range(n)]
    for kind in (alignment.Similarity, alignment.FormSimilarity):
        similarity = kind({("n", "car", "auto")}, {("big", "tree")})
        for _ in range(60):
            s, t = sentence(8), sentence(6)
            assert alignment.linked(s, t, similarity) == {(i, j): x for i, a in enumerate(s) for j, b in enumerate(t) if (x := similarity(a, b)) > 0}

    class Other(alignment.Similarity):  # names no keys, so all pairs are looked at
        def __call__(self, a, b):
            return 0.5

    assert len(alignment.linked(s, t, Other())) == 48
    real = alignment.Similarity.__call__
    monkeypatch.setattr(alignment.Similarity, "__call__", lambda self, a, b: calls.append(1) or real(self, a, b))
    word = lambda w: {"word": w, "pos": "NN", "deps": {}}
    alignment.sentence_features([word(f"a{i}") for i in range(40)], [word(f"b{i}") for i in range(39)] + [word("a1")], alignment.Similarity())
    assert len(calls) == 1


def test_alignment_is_one_pass_over_the_pairs(spark):
    rows = [(1, "the dog walks home", "the dog walks away"), (2, None, ""), (3, "a b", None)]
    pairs = spark.createDataFrame(rows, "pair_id long, question1 string, question2 string")
    found = alignment.alignment_features(alignment.annotated_simply(pairs))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r["pair_id"]: r for r in found.collect()}
    assert got[1]["sem_sim"] == 0.75 and got[1]["len_dif"] == 0 and got[2]["len_dif"] == 1 and len(got) == 3


def test_sentences_of_a_slice_and_of_nulls():
    kind = pa.list_(pa.struct([("word", pa.string()), ("pos", pa.string()), ("ner", pa.string()), ("deps", pa.map_(pa.int32(), pa.string()))]))
    token = lambda w, deps: {"word": w, "pos": "NN", "ner": "O", "deps": deps}
    column = pa.array([[token("x", [(5, "no")])], None, [], [token("a", []), token("b", [(0, "nmod")])], None], kind)
    want = [None, [], [{"word": "a", "pos": "NN", "deps": {}}, {"word": "b", "pos": "NN", "deps": {0: "nmod"}}], None]
    assert alignment.sentences(column.slice(1)) == want and alignment.sentences(column.slice(1, 1)) == [None]
