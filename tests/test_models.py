"""SVD against numpy, out-of-fold blocks written out, models kept and read again, feature tables read back."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from pairloom.operators import alignment, graph, lexical, modeling, neural, spectral, term_blocks
from pairloom.sources import pairs as sources

ROWS = [(1, "a b b", "b c", 1, "train"), (2, "", "x", 0, "train"), (3, None, None, 0, "test"), (4, "The cat", "the cat", 1, "train"), (5, "a", "a a a", 0, "test")]
SCHEMA = "pair_id bigint, question1 string, question2 string, is_duplicate int, split string"


def test_svd_matches_numpy(spark):
    rng = np.random.default_rng(0)
    data = [[int(x) for x in np.minimum(39, rng.geometric(0.12, rng.integers(0, 30)))] for _ in range(300)] + [[0] * 50_000, [], None]
    df = spark.createDataFrame(list(enumerate(data)), "id int, ids array<int>")
    counts = np.zeros((len(data), 40))
    for i, ids in enumerate(data):
        np.add.at(counts[i], ids or [], 1)
    v = spectral.truncated_svd(df, "ids", 40, 5, passes=12)
    true = np.linalg.svd(counts)[2][:5].T
    assert np.abs(np.abs((v * true).sum(axis=0)) - 1).max() < 1e-6
    got = np.array([r["p"] for r in spectral.projected(df, "ids", v, "p").orderBy("id").collect()])
    assert np.allclose(got, counts @ v)
    again = spectral.truncated_svd(df.repartition(3), "ids", 40, 5, passes=12)
    assert np.allclose(v, again)
    assert spectral.truncated_svd(df.limit(0), "ids", 40, 5).shape == (40, 5)


def test_sparse_blocks_match_counts(spark):
    pairs = spark.createDataFrame(ROWS, SCHEMA)
    found = term_blocks.blocks(pairs, folds=2, k=3, buckets=1 << 10)
    place = {w: r for w, r in spark.createDataFrame([(w,) for w in "a b c x the cat The".split()], "w string").select("w", spectral.bucket(F.col("w"), 1 << 10)).collect()}
    assert all(t.count() == len(ROWS) for t in found.values()) and set(found) == set(modeling.BLOCKS)
    rows = lambda name: {r["pair_id"]: np.array(r["v"]) for r in found[name].select("pair_id", vector_to_array("features").alias("v")).collect()}
    tf, diff, absolute, product, lemma = (rows(n) for n in ("tf", "diff_tf", "svd_absdiff", "svd_mult", "w1l_tfidf"))
    assert tf[1][place["b"]] == 2 and tf[1][1024 + place["c"]] == 1 and tf[1].sum() == 5 and tf[3].sum() == 0
    assert diff[1][place["b"]] == 1 and diff[1][place["c"]] == -1 and diff[5][place["a"]] == -2 and not diff[3].any()
    assert not absolute[3].any() and not product[2].any() and (absolute[5] >= 0).all()
    assert np.allclose(lemma[4][:1024], lemma[4][1024:]) and np.linalg.norm(lemma[4][:1024]) == pytest.approx(1.0)


def learnable(spark, n=400):
    df = spark.range(n).select(F.col("id").alias("pair_id"), (F.col("id") % 2).cast("int").alias("is_duplicate"), F.when(F.col("id") % 5 == 0, "test").otherwise("train").alias("split"), (F.col("id") % 2 * 3.0 + F.col("id") % 7 / 3).alias("x"))
    return modeling.with_fold(modeling.assembled(df, ["x"]), 3)


@pytest.mark.parametrize("estimator", [lambda: modeling.logistic(0.1, 1e-3), lambda: modeling.boosted_trees(depth=2, rounds=4, valid="held")])
def test_models_are_kept_and_read_again(spark, tmp_path, estimator):
    df = learnable(spark)
    first = modeling.out_of_fold(df, estimator, 3, "p", save_to=str(tmp_path / "m"))
    models = modeling.load_models(str(tmp_path / "m"), 3)
    again = modeling.predict_folds(df, models, "p")
    one, two = ({r["pair_id"]: r["p"] for r in t.collect()} for t in (first, again))
    assert len(one) == 400 and one.keys() == two.keys() and all(one[k] == pytest.approx(two[k]) for k in one)
    # each train row by its own fold's model, each test row by the mean
    plain = [{r["pair_id"]: r["p"] for r in modeling.positive(m.transform(df), "p").select("pair_id", "p").collect()} for m in models]
    for r in df.select("pair_id", "split", "fold").collect():
        want = plain[r["fold"]][r["pair_id"]] if r["split"] == "train" else sum(p[r["pair_id"]] for p in plain) / 3
        assert one[r["pair_id"]] == pytest.approx(want)
    modeling.save_models(models[:1], str(tmp_path / "m"))  # an older set is replaced


def test_trees_stop_early_by_the_held_out_fold(spark):
    noise = learnable(spark).withColumn("is_duplicate", F.pmod(F.xxhash64("pair_id"), F.lit(2)).cast("int"))
    models = modeling.fit_folds(noise, lambda: modeling.boosted_trees(depth=4, rounds=30, rate=0.5, valid="held"), 3)
    assert all(m.getNumTrees < 30 for m in models)


def test_feature_tables_are_read_side_by_side(spark, tmp_path):
    one = spark.createDataFrame([(1, 2.0, "train"), (2, 3.0, "test")], "pair_id bigint, x double, split string")
    sources.write_features(one, f"{tmp_path}/one")
    sources.write_features(one.withColumnRenamed("x", "y"), f"{tmp_path}/two")
    got = sources.read_features(spark, str(tmp_path), ["one", "two"])
    assert got.columns == ["pair_id", "x", "y"] and sorted(map(tuple, got.collect())) == [(1, 2.0, 2.0), (2, 3.0, 3.0)]
    sources.write_features(one, f"{tmp_path}/three")
    with pytest.raises(ValueError, match="more than one family"):
        sources.read_features(spark, str(tmp_path), ["one", "three"])


def test_annotated_pickles_are_read_as_plain_values(spark, tmp_path):
    import gzip
    import pickle

    toks = lambda *words: [{"index": i, "word": w, "pos": "NN", "ner": "O"} for i, w in enumerate(words, 1)]
    deps = [{"governor": 0, "dependent": 2, "dep": "ROOT"}, {"governor": 2, "dependent": 1, "dep": "amod"}]
    pairs = [{"id": i, "is_duplicate": i % 2, "q1": {"raw": "Big dog", "toks": toks("Big", "dog"), "deps": deps}, "q2": {"raw": "", "toks": [], "deps": []}} for i in range(2500)]
    with gzip.open(tmp_path / "a.nlp", "wb") as out:
        for p in pairs:
            pickle.dump(p, out, protocol=pickle.HIGHEST_PROTOCOL)
    got = sources.read_annotated_pickles(spark, f"{tmp_path}/a.nlp")
    rows = {r["pair_id"]: r for r in got.collect()}
    assert len(rows) == 2500 and rows[3]["is_duplicate"] == 1 and rows[3]["t"] == []
    assert [(w["word"], w["deps"]) for w in rows[3]["s"]] == [("big", {}), ("dog", {0: "amod"})]
    sources.write_annotated(got, f"{tmp_path}/parsed")
    assert sorted(sources.read_annotated(spark, f"{tmp_path}/parsed").select("pair_id", "s.word").collect()) == sorted(got.select("pair_id", "s.word").collect())
    assert alignment.alignment_features(got).count() == 2500
    (tmp_path / "code.nlp").write_bytes(pickle.dumps({"id": print}))
    with pytest.raises(Exception, match="plain values"):
        sources.read_annotated_pickles(spark, f"{tmp_path}/code.nlp").collect()
    (tmp_path / "p.pkl").write_bytes(pickle.dumps([0.5, 0.25], protocol=3))
    assert sorted(r["p"] for r in sources.read_pickled_rows(spark, f"{tmp_path}/p.pkl", "p double").collect()) == [0.25, 0.5]
    (tmp_path / "t.pkl").write_bytes(pickle.dumps([(1, "a"), (2, None)]) + pickle.dumps([]))
    assert sorted(map(tuple, sources.read_pickled_rows(spark, f"{tmp_path}/t.pkl", "id bigint, word string").collect())) == [(1, "a"), (2, None)]


def test_dense_ids_follow_first_appearance(spark):
    texts = [(i, f"q{(i * 7) % 40}", None if i % 9 == 0 else f"q{(i * 3) % 50}", 0, "train") for i in range(300)]
    want, seen = {}, [t for r in texts for t in r[1:3]]
    for t in seen:
        want.setdefault(t, len(want))
    df = spark.createDataFrame(texts, SCHEMA).repartition(5)
    assert {r["question"]: r["qid"] for r in graph.dense_ids(df).collect()} == want
    assert graph.dense_ids(df.limit(0)).count() == 0
    totals = {r["term"]: r["total"] for r in lexical.term_totals(df).collect()}
    assert sum(totals.values()) == sum(t is not None for t in seen) and totals["q0"] == seen.count("q0")


def test_word_forms_and_diagonal():
    word = lambda w, pos="NN": {"word": w, "pos": pos}
    sim = alignment.FormSimilarity(paraphrases={("car", "auto")})
    assert sim(word("dog"), word("dog")) == 1 and sim(word("dogs"), word("dog")) == 0.9 and sim(word("dogs"), word("dog", "VB")) == 0
    assert sim(word("compute"), word("company")) == 0.7 and sim(word("car"), word("auto")) == 0.7 and sim(word("cat"), word("dog")) == 0
    assert alignment.diagonal_similarity([word("a"), word("dogs"), word("x")], [word("a"), word("dog")], sim) == [1.0, 0.9]


def test_two_way_net_sums_positions(spark):
    table = np.random.default_rng(0).normal(size=(30, 5))
    net = neural.BiRecurrent(table, 4)
    ids = np.array([[1, 2, 3], [3, 2, 1]])
    x = net.encode(ids)
    states = [sum(neural._lstm(table[ids[:, :t]], net.w["forth"], 4) for t in range(1, 4)), sum(neural._lstm(table[ids[:, ::-1][:, :t]], net.w["back"], 4) for t in range(1, 4))]
    assert np.allclose(x, np.concatenate(states, 1)) and ((p := net(ids, ids[::-1])) > 0).all() and (p < 1).all()
