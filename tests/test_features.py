"""Micro fixtures for the pair features: overlap, empty and null sides, stop words only, self pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from pairloom.functions import fuzzy
from pairloom.operators import alignment, graph, lexical, modeling, neural, postprocess, sequences, vector_features
from pairloom.sources import pairs as sources
from pairloom.streaming import pairs as streaming

SCHEMA = "pair_id bigint, question1 string, question2 string, is_duplicate int, split string"
ROWS = [
    (1, "a b c", "b c d", 1, "train"), (2, "", "x", 0, "train"), (3, None, "x", 0, "test"), (4, "the of", "the of", 1, "train"),
    (5, "kiwi kiwi plum", "kiwi plum plum", 1, "train"), (6, "show me", "How?", 0, "test"), (7, "Ab É", "ab", 0, "test"), (8, "x", "x", None, "test"),
]


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def by_id(df):
    return {r["pair_id"]: r for r in df.collect()}


def test_lengths_and_capitals(pairs):
    got = by_id(lexical.length_features(pairs))
    assert got[1]["char_len1"] == 5 and got[1]["word_len1"] == 3 and got[2]["word_len1"] == 0 and got[3]["char_len1"] == 3
    assert got[2]["char_len_diff_ratio"] == 1.0
    caps = by_id(lexical.capital_features(pairs))
    assert caps[7]["caps_count_q1"] == 2 and caps[7]["diff_caps"] == 2 and caps[2]["avg_world_len1"] is None
    words = by_id(lexical.question_word_features(pairs))
    assert words[6]["q1_how"] == words[6]["q2_how"] == words[6]["how_both"] == 1 and words[1]["how_both"] == 0


def test_overlaps(pairs):
    got = by_id(lexical.match_features(pairs))
    assert got[4]["word_match_ratio"] == 0.0 and got[2]["word_match_ratio"] == 0.0 and got[5]["word_match_ratio"] == 1.0
    assert got[5]["noun_match_count"] == 3 and got[5]["bigrams_nostop_match_count"] == 1
    shares = by_id(lexical.weighted_share_features(pairs))
    assert shares[4]["words_hamming"] == 0.0 and shares[1]["words_hamming"] == 0.0 and shares[5]["tfidf_word_match_ratio_2"] == 1.0 and shares[5]["words_hamming"] == pytest.approx(2 / 3)
    chars = by_id(lexical.char_jaccard_features(pairs))
    assert chars[2]["trigram_jaccard"] == 0.0 and chars[8]["unigram_all_jaccard"] == 0.5 and chars[8]["unigram_all_jaccard_max"] == 1.0


def test_contractions_are_parted(spark):
    from pairloom.functions.text import contraction_tokens

    want = {
        "Don't they've it's": "do n't they 've it 's", "I cannot, gonna go.": "i can not , gon na go .", 'He said "well..." (3.5%)!': "he said `` well ... '' ( 3.5 % ) !",
        "the dogs' bone": "the dogs ' bone", "a.b. c": "a.b. c", "": "", "  x\t\ny ": "x y", "What're you--": "what 're you --",
    }
    df = spark.createDataFrame([(t,) for t in want], "t string")
    assert {r["t"]: " ".join(r["w"]) for r in df.select("t", contraction_tokens(F.col("t")).alias("w")).collect()} == want
    pairs = spark.createDataFrame([(1, "Don't go", "don't stop", 1, "train"), (2, None, "", 0, "test")], SCHEMA)
    one, two = (by_id(lexical.match_features(pairs, tokenizer=t)) for t in (lexical.tokenize, contraction_tokens))
    assert two[1]["unigrams_nostop_match_count"] == 1 and one[1]["unigrams_nostop_match_count"] == 1 and len(two) == 2
    assert by_id(vector_features.tfidf_features(pairs, ["go"]))[1]["tfidf_len1"] == 1 and by_id(vector_features.tfidf_features(pairs))[1]["tfidf_len1"] == 1
    assert by_id(vector_features.tfidf_features(pairs, []))[1]["tfidf_len1"] == 2


def test_capped_lengths(pairs):
    got = by_id(lexical.capped_length_features(pairs))
    assert got[8]["ratio_len1_len2"] == 1.0 and got[2]["len1"] == 0.0 and got[2]["log_abs_diff_len1_len2"] <= math.log(2)


def test_simhash(pairs):
    got = by_id(lexical.simhash_features(pairs))
    assert got[8]["simhash_tokenize_distance"] == 0 and got[4]["simhash_char_3gram_distance"] == 0 and 0 < got[2]["simhash_tokenize_distance"] <= 64


def test_fuzzy_ratios():
    ratio = lambda name, a, b: fuzzy.FUZZ[f"fuzz_{name}"](fuzzy.Ratios(a, b))
    assert ratio("qratio", "New York", "new york!") == 100 and ratio("token_sort_ratio", "b a", "a b") == 100 and ratio("token_set_ratio", "a b c", "a b") == 100
    assert ratio("partial_ratio", "york", "new york city") == 100 and ratio("qratio", "", "x") == 0 and ratio("WRatio", "abc def", "def abc") == 95


def test_matching_blocks_are_those_of_the_sequence_matcher(monkeypatch):
    from difflib import SequenceMatcher

    rng = random.Random(8)
    text = lambda most: "".join(rng.choice("abc d") for _ in range(rng.randrange(most)))
    pairs = [(text(60), text(60)) for _ in range(400)] + [(text(40), text(400)) for _ in range(20)] + [("", ""), ("", "a"), ("abcabc", "abc")]
    plain = [SequenceMatcher(None, a, b).ratio() for a, b in pairs]
    assert [fuzzy.sequence_ratio(a, b) for a, b in pairs] == plain
    monkeypatch.setattr(fuzzy, "SequenceMatcher", lambda *_: pytest.fail("the slow matcher on a short text"))
    short = [(p, r) for p, r in zip(pairs, plain, strict=True) if len(p[1]) < fuzzy.POPULAR]
    assert [fuzzy.sequence_ratio(*p) for p, _ in short] == [r for _, r in short]


def test_fuzzy_ratios_match_plain_definitions():
    """Every ratio written out without shortcuts, on random texts."""
    from difflib import SequenceMatcher

    def plain(a, b):
        return round(100 * SequenceMatcher(None, a, b).ratio())

    def partial(a, b):
        a, b = sorted((a, b), key=len)
        if not a:
            return 0 if b else 100
        found = [SequenceMatcher(None, a, b[max(0, m.b - m.a) :][: len(a)]).ratio() for m in SequenceMatcher(None, a, b).get_matching_blocks()]
        return 100 if max(found) > 0.995 else round(100 * max(found))

    def tokens(a, b, score, sets):
        x, y = (fuzzy.processed(t).split() for t in (a, b))
        if not x or not y:
            return 0
        if not sets:
            return score(" ".join(sorted(x)), " ".join(sorted(y)))
        parts = [" ".join(sorted(s)) for s in (set(x) & set(y), set(x) - set(y), set(y) - set(x))]
        full = [f"{parts[0]} {p}".strip() for p in parts[1:]]
        return max(score(parts[0], full[0]), score(parts[0], full[1]), score(*full))

    rng = random.Random(3)
    for _ in range(300):
        a, b = (" ".join(rng.choice(["new", "york", "City?", "of", "A", "cityof", "ynew", "--"]) for _ in range(rng.randrange(0, 9))) for _ in range(2))
        got = {n: f(fuzzy.Ratios(a, b)) for n, f in fuzzy.FUZZ.items()}
        assert got["fuzz_partial_ratio"] == partial(*((a, b) if len(a) <= len(b) else (b, a)))
        assert got["fuzz_token_sort_ratio"] == tokens(a, b, plain, False) and got["fuzz_token_set_ratio"] == tokens(a, b, plain, True)
        assert got["fuzz_partial_token_sort_ratio"] == tokens(a, b, partial, False) and got["fuzz_partial_token_set_ratio"] == tokens(a, b, partial, True)


def test_graph_rules(spark):
    rows = [(1, "a", "b"), (2, "b", "c"), (3, "a", "c"), (4, "c", "d"), (5, "a", "a"), (6, "a", "b"), (7, "b", "a"), (8, None, "z")]
    df = spark.createDataFrame([(*r, 1, "train") for r in rows], SCHEMA)
    freq = by_id(graph.frequency(df))
    assert freq[1]["q1_freq"] == 6 and freq[1]["q2_freq"] == 4 and freq[8]["q1_freq"] == 1
    clique = {k: r["clique_size"] for k, r in by_id(graph.clique_size(df)).items()}
    assert clique == {1: 3, 2: 3, 3: 3, 4: 2, 5: -1, 6: 3, 7: 3, 8: 2}
    assert {k: r["triangles"] for k, r in by_id(graph.triangles(df)).items()} == {1: 1, 2: 1, 3: 1, 4: 0, 5: 0, 6: 1, 7: 1, 8: 0}
    assert by_id(graph.common_neighbours(df))[1]["q1_q2_intersect"] == 2  # a (its own neighbour) and c
    ranks = by_id(graph.pagerank(df, steps=40))
    nodes = {("a", ranks[1]["q1_pr"]), ("b", ranks[1]["q2_pr"]), ("c", ranks[2]["q2_pr"]), ("d", ranks[4]["q2_pr"]), ("", ranks[8]["q1_pr"]), ("z", ranks[8]["q2_pr"])}
    assert sum(p for _, p in nodes) == pytest.approx(1.0)
    parts = by_id(graph.component_sizes(df))
    assert parts[1]["subgraph_nodes"] == 4 and parts[1]["subgraph_edges"] == 4 and parts[8]["subgraph_nodes"] == 2


def test_vectors(spark, pairs):
    words = spark.createDataFrame([("kiwi", [1.0, 0.0]), ("plum", [0.0, 1.0])], "word string, vec array<float>")
    e = by_id(vector_features.embedding_features(pairs, words, 2, "v"))
    assert e[5]["v_euclidean_distance"] == pytest.approx(math.sqrt(2 * (2 / math.sqrt(5) - 1 / math.sqrt(5)) ** 2)) and e[1]["v_cosine_distance"] is None and e[1]["v_cityblock_distance"] == 0
    w = by_id(vector_features.wmd_features(pairs, words, "v"))
    assert w[5]["v_wmd"] == pytest.approx(math.sqrt(2) / 3) and w[1]["v_wmd"] == math.inf
    t = by_id(vector_features.tfidf_features(pairs))
    assert t[2]["tfidf_sum1"] == 0.0 and t[5]["tfidf_len1"] == 2
    d = by_id(vector_features.trigram_distance_features(pairs))
    assert d[8]["trigram_tfidf_cosine"] == 0.0 and d[4]["trigram_tfidf_cosine"] == pytest.approx(0.0)


def test_transport_matches_assignment():
    from itertools import permutations

    cost = [[4.0, 1.0, 3.0], [2.0, 0.0, 5.0], [3.0, 2.0, 2.0]]
    best = min(sum(cost[i][p[i]] for i in range(3)) for p in permutations(range(3))) / 3
    assert vector_features.transport_cost([1 / 3] * 3, [1 / 3] * 3, cost) == pytest.approx(best)


def test_transport_costs_by_brute_force():
    """Masses of whole units: every way to match units is tried."""
    from itertools import permutations

    import numpy as np

    rng = np.random.default_rng(8)
    for _ in range(150):
        size = int(rng.integers(2, 7))
        cuts = lambda: np.bincount(rng.integers(0, int(rng.integers(1, size + 1)), size))
        a, b = (x[x > 0] for x in (cuts(), cuts()))
        cost = rng.integers(0, 4, (len(a), len(b))).astype(float) if rng.random() < 0.5 else rng.random((len(a), len(b)))
        rows, columns = np.repeat(np.arange(len(a)), a), np.repeat(np.arange(len(b)), b)
        best = min(sum(cost[rows[i], columns[j]] for i, j in enumerate(p)) for p in permutations(range(size))) / size
        assert vector_features.transport_cost(a / size, b / size, cost) == pytest.approx(best, abs=1e-9)


def test_large_transport_has_no_better_prices():
    """Weak duality: the cost lies between any feasible flow and any feasible prices; row and column minima are such prices."""
    import numpy as np

    rng = np.random.default_rng(9)
    for n, m in ((40, 60), (30, 30), (1, 50)):
        s, d, cost = rng.dirichlet(np.ones(n)), rng.dirichlet(np.ones(m)), rng.random((n, m))
        found = vector_features.transport_cost(s, d, cost)
        low = cost.min(axis=1)
        assert low @ s + (cost - low[:, None]).min(axis=0) @ d - 1e-9 <= found <= (s[:, None] * d * cost).sum() + 1e-9
        assert found == pytest.approx(vector_features.transport_cost(d, s, cost.T), abs=1e-9)


def test_residual_ranks_match_many_steps(spark):
    rng = random.Random(11)
    rows = [(i, f"n{min(rng.randrange(60), rng.randrange(60))}", f"n{rng.randrange(60)}", 0, "train") for i in range(150)] + [(900, "x", "x", 0, "train"), (901, None, "y", 0, "train")]
    df = spark.createDataFrame(rows, SCHEMA)
    want, got = by_id(graph.pagerank(df, 0.5, steps=32)), by_id(graph.pagerank(df, 0.5, tol=1e-6))
    assert got.keys() == want.keys() and all(abs(got[k][c] - want[k][c]) < 1e-6 for k in want for c in ("q1_pr", "q2_pr"))
    links, nodes = graph._links(df)
    ranks, sent = graph.converged_ranks(links, nodes, 0.6, 1e-3)
    assert sent[0] == nodes.count() and sent[-1] == 0 and sum(sent) < sent[0] * len(sent) and min(sent[:-1]) < sent[0]
    assert ranks.agg(F.sum("pr")).first()[0] == pytest.approx(1, abs=1e-3)
    assert graph.pagerank(df.limit(0), tol=0.1).count() == 0


def test_graph_rounds_move_numbers_not_texts(spark, monkeypatch):
    seen, share = {}, graph.shared_table
    for module in (graph, postprocess):
        monkeypatch.setattr(module, "shared_table", lambda df, label, *a: seen.setdefault(label, set()).update(t for _, t in df.dtypes) or share(df, label, *a))
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", "c", "d", None]), rng.choice(["a", "b", "e", None]), "train" if i % 2 else "test", i % 2, 0.6) for i in range(30)]
    pairs = spark.createDataFrame(rows, "pair_id long, question1 string, question2 string, split string, is_duplicate int, p double")
    got = {f.__name__: f(pairs).count() for f in (graph.component_sizes, graph.common_neighbours, graph.triangles, postprocess.transitivity)}
    got["pagerank"] = graph.pagerank(pairs, steps=2).count()
    assert got == {"component_sizes": 30, "common_neighbours": 30, "triangles": 30, "transitivity": 15, "pagerank": 30}
    assert seen["edges"] and all("string" not in seen[label] for label in ("edges", "labels", "links", "ranks", "weights"))


def test_all_words_are_numbered(spark, monkeypatch):
    from pairloom.plans import registry

    monkeypatch.setattr(sequences.vocabulary, "__defaults__", (3,))
    pairs = spark.createDataFrame([(i, f"w{i % 7} a b", f"w{i % 5} a", "train", 0) for i in range(40)], "pair_id long, question1 string, question2 string, split string, is_duplicate int")
    counts = {}
    for r in pairs.collect():
        for w in f"{r['question1']} {r['question2']}".split():
            counts[w] = counts.get(w, 0) + 1
    ranked = sorted(counts, key=lambda w: (-counts[w], w))
    got = registry.queries()["sequence_vocabulary"](spark, "", pairs)
    assert [tuple(r) for r in got.orderBy("word_id").collect()] == [(w, i) for i, w in enumerate(ranked, 1)]


def test_mean_matching_reads_the_documents_once(spark, tmp_path, monkeypatch):
    from pairloom.plans import registry

    spark.createDataFrame([(i, f"Same words {i} here", "en", "s", 9) for i in range(30)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    read, match = [], postprocess.match_mean
    monkeypatch.setattr(postprocess, "match_mean", lambda df, *a: read.extend(df.inputFiles()) or match(df, *a))
    assert registry.queries()["mean_matching"](spark, str(tmp_path)).count() > 30
    assert read and not any("documents" in f for f in read)


def test_questions_are_cut_before_they_are_split(spark, tmp_path):
    texts = ["  two  spaces", "a\nb\tc\r\nd", "", None, " ".join(f"W{i}" for i in range(200)), "x " * 59 + "y z", "\u039f\u0394\u039f\u03a3 one"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sources.pairs_from_documents(spark, str(tmp_path))
    flat = F.regexp_replace("text", "[ \\n\\r\\t]+", " ")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    plain = {r[0]: r[1] for r in docs.select("doc_id", F.array_join(F.slice(F.split(flat, " "), 1, 12), " ")).collect()}
    rows = got.collect()
    assert {r["qid1"] for r in rows} >= set(range(len(texts) - 1)) and all(r["question1"] == plain[r["qid1"]] and r["question2"] == plain[r["qid2"]] for r in rows)
    assert "regexp_replace" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_sequences(pairs):
    vocab = sequences.vocabulary(pairs)
    ids = {r["word"]: r["word_id"] for r in vocab.collect()}
    assert sorted(ids.values()) == list(range(1, len(ids) + 1)) and ids["x"] == 1
    got = by_id(sequences.encode(pairs, vocab, 2))
    assert got[2]["ids1"] == [0, 0] and got[2]["ids2"] == [0, 1] and got[5]["ids1"] == [ids["kiwi"], ids["plum"]]


def test_prior_shift_and_rules(spark):
    p = spark.createDataFrame([(0.0,), (0.369197853026,), (1.0,)], "p double").select(postprocess.prior_shift(F.col("p")).alias("p")).collect()
    assert [r["p"] for r in p] == [0.0, pytest.approx(0.174264424749), 1.0]
    rows = [(1, "a", "b", 1, "train", None), (2, "b", "c", 1, "train", None), (3, "a", "c", None, "test", 0.6), (4, "a", "e", None, "test", 0.05), (5, "a", "c", None, "test", 0.985)]
    df = spark.createDataFrame(rows, SCHEMA + ", p double")
    got = by_id(postprocess.transitivity(df))
    assert got[3]["p"] == pytest.approx(0.6 + 0.19 + 0.095) and got[4]["p"] == pytest.approx(0.05) and got[5]["p"] == 0.985
    implied = postprocess.implied_labels(df.filter("split = 'train'")).collect()
    assert [tuple(r) for r in implied] == [("a", "c", 1)]


def test_mean_matching_and_folds(spark):
    df = spark.range(2000).select(F.col("id").alias("pair_id"), (F.col("id") % 97 / 100.0 + 0.01).alias("p"), (F.col("id") % 3 == 0).cast("int").alias("is_duplicate"))
    assert postprocess.match_mean(df, "p", 0.2).agg(F.avg("p")).first()[0] == pytest.approx(0.2, abs=1e-6)
    sizes = modeling.with_stratified_fold(df).groupBy("is_duplicate", "fold").count().collect()
    for label in (0, 1):
        n = [r["count"] for r in sizes if r["is_duplicate"] == label]
        assert len(n) == 10 and max(n) - min(n) <= 1
    share = modeling.oversampled(df, 0.1).agg(F.avg("is_duplicate")).first()[0]
    assert share == pytest.approx(0.1, abs=0.01)
    m = modeling.metrics(df.withColumn("p", F.col("is_duplicate") * 0.8 + 0.1)).first()
    assert m["auc"] == m["f1"] == 1.0 and m["log_loss"] == pytest.approx(-math.log(0.9))


def written_out(s, t, sim, faithful):
    """The alignment as plain loops over all pairs."""
    value = {(i, j): sim(s[i], t[j]) for i in range(len(s)) for j in range(len(t))}
    out = set()
    for by_text in (False, True):
        found = []
        for (i, j), v in value.items():
            if by_text:
                near = [(k, m) for (k, m) in value if 0 < abs(k - i) <= 3 and 0 < abs(m - j) <= 3]
            else:
                near = alignment.dependency_context(s, t, [[value[a, b] for b in range(len(t))] for a in range(len(s))], i, j)
            total = sum(value[c] for c in near)
            if v > 0 and total > 0:
                found.append((0.75 * v + 0.25 * total, i, j, [c for c in near if value[c] > 0]))
        used = [], []
        for _, i, j, near in sorted(found, key=lambda f: (-f[0], f[1], f[2])):
            free = i not in used[0] and j not in used[1]
            if free:
                out.add((i, j))
                used[0].append(i), used[1].append(j)
            if by_text or not (free or faithful):
                continue
            for k, m in near:
                if k not in used[0] and m not in used[1]:
                    out.add((k, m))
                    used[0].append(i if faithful else k)
                    used[1].append(j if faithful else m)
    return out


def test_alignment_modes_match_loops_written_out():
    rng = random.Random(8)
    sim = alignment.Similarity({("v", "chase", "hunt")}, {("mice", "rats")})
    different = 0

    def sentence():
        n = rng.randrange(0, 7)
        out = [{"word": w, "lemma": w, "pos": rng.choice(["NN", "VB"]), "deps": {}, "ner": "O"} for w in rng.choices(["cat", "chase", "hunt", "mice", "rats", "dog"], k=n)]
        for i in range(1, n):
            out[i]["deps"][rng.randrange(i)] = rng.choice(["subj", "obj"])
        return out

    for _ in range(400):
        s, t = sentence(), sentence()
        for faithful in (True, False):
            assert alignment.align(s, t, sim, faithful) == written_out(s, t, sim, faithful)
        different += alignment.align(s, t, sim, True) != alignment.align(s, t, sim, False)
    assert different


def test_alignment():
    token = lambda w, pos, deps=None: {"word": w, "pos": pos, "ner": "O", "deps": deps or {}}
    s = [token("cats", "NNS", {}), token("chase", "VBP", {0: "nsubj", 2: "dobj"}), token("mice", "NNS")]
    t = [token("cats", "NNS", {}), token("hunt", "VBP", {0: "nsubj", 2: "dobj"}), token("rats", "NNS")]
    sim = alignment.Similarity({("v", "chase", "hunt")}, {("mice", "rats")})
    assert alignment.align(s, t, sim) == {(0, 0), (1, 1), (2, 2)}
    got = alignment.sentence_features(s, t, alignment.Similarity())
    # the only equal words have no similar words around them, without which nothing is aligned
    assert got["sem_sim"] == 0 and got["S_unmatch_n"] == 1 and got["S_unmatch_n_p"] == 0.5 and got["S_unmatch_v"] == 1
    assert alignment.sentence_features(s, t, sim)["sem_sim"] == 1
    assert alignment.sentence_features(None, t, sim)["sem_sim"] is None and alignment.sentence_features([], t, sim)["S_sem_sim"] is None


def test_networks_are_probabilities(spark):
    import numpy as np

    table = np.random.default_rng(0).normal(size=(50, 6))
    df = spark.createDataFrame([(i, [0, i % 50, 3], [0, 5, 400]) for i in range(20)], "pair_id bigint, ids1 array<bigint>, ids2 array<bigint>")
    for net in (neural.LstmConcat(table, 4), neural.DecomposableAttention(table, 4, 10), neural.Convolutions(table, (4, 4, 2))):
        p = [r["p"] for r in neural.score(df, net).collect()]
        assert len(p) == 20 and all(0 < x < 1 for x in p)


def test_sources_round_trip(spark, tmp_path):
    (tmp_path / "train.csv").write_text('id,qid1,qid2,question1,question2,is_duplicate\n0,1,2,"a ""b"",\nc",d,1\n')
    (tmp_path / "test.csv").write_text("test_id,question1,question2\n0,x,y\n")
    both = sources.combined(sources.read_train_csv(spark, str(tmp_path / "train.csv")), sources.read_test_csv(spark, str(tmp_path / "test.csv")))
    rows = sorted(both.select("split", "question1", "is_duplicate").collect())
    assert rows[1]["question1"] == 'a "b",\nc' and rows[0]["is_duplicate"] is None
    sources.write_features(lexical.length_features(both.withColumn("pair_id", F.col("pair_id"))).withColumn("split", F.lit("train")), str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).count() == 2
    (tmp_path / "v.txt").write_text("2 3\na 1 2 3\nof the 4 5 6\n")
    assert {r["word"]: r["vec"] for r in sources.read_word_vectors(spark, str(tmp_path / "v.txt"), 3).collect()} == {"a": [1, 2, 3], "of the": [4, 5, 6]}
    (tmp_path / "n.json").write_text('{"cat": ["feline", "kitty"]}')
    assert sources.read_dictionary(spark, str(tmp_path / "n.json"), "n").count() == 2
    import numpy as np

    (tmp_path / "w.bin").write_bytes(b"2 2\nab " + np.array([1, 2], "<f4").tobytes() + b"\ncd " + np.array([3, 4], "<f4").tobytes())
    assert {r["word"]: r["vec"] for r in sources.read_word_vectors_binary(spark, str(tmp_path / "w.bin")).collect()} == {"ab": [1, 2], "cd": [3, 4]}


def test_annotator_failures_keep_the_pair(pairs):
    def annotator(text):
        if "?" in text:
            raise ValueError
        return [(w, "NN", "O", {}) for w in text.split()]

    got = by_id(sources.annotate(pairs, annotator))
    assert len(got) == len(ROWS) and got[6]["t"] is None and got[3]["s"][0]["word"] == "null"


def test_streaming_matches_batch(spark, pairs, tmp_path):
    pairs.withColumn("ts", F.to_timestamp(F.lit("2024-01-01 00:05:00"))).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA + ", ts timestamp").parquet(str(tmp_path / "in"))
    got = streaming.run_available(streaming.stream_features(stream, lexical.length_features), "lengths")
    assert sorted(got.collect()) == sorted(lexical.length_features(pairs).collect())
    counts = streaming.run_available(streaming.windowed_frequency(stream), "freq", "complete").filter("question = 'x'").collect()
    assert [r["n"] for r in counts] == [4]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for f in (lexical.length_features, lexical.match_features, lexical.weighted_share_features, lexical.capped_length_features, vector_features.tfidf_features, graph.frequency, graph.clique_size, graph.pagerank):
        assert f(empty).count() == 0


def star_and_ring(leaves, ring):
    """One hub with many leaves, and a ring of which every tenth node hangs on the hub, too."""
    edges = [("hub", f"leaf{i}") for i in range(leaves)] + [(f"r{i}", f"r{(i + 1) % ring}") for i in range(ring)]
    return edges + [("hub", f"r{i}") for i in range(0, ring, 10)]


def test_hubs_are_walked_from_the_other_end(spark):
    edges = star_and_ring(50_000, 1000)
    pairs = spark.createDataFrame([(i, a, b, 0, "train") for i, (a, b) in enumerate(edges)], SCHEMA)
    both = graph.simple_edges(pairs, "", loops=False)
    asked = graph.with_ends(pairs).select("x", "y").distinct()
    for hub in (7, graph.HUB):  # few and many slices give the same rows
        rows = graph.walked(asked, both, hub)
        assert rows.count() <= 2 * both.count() and rows.distinct().count() == rows.count()
    found = by_id(graph.triangles(pairs))
    assert {r["triangles"] for r in found.values()} == {0}
    near = by_id(graph.common_neighbours(pairs.filter("question1 not like 'leaf%' and question2 not like 'leaf%'")))
    assert sum(r["q1_q2_intersect"] for r in near.values()) == 0
    # two hubs that share all their leaves: either end is walked once, in slices
    twins = spark.createDataFrame([(i, h, f"leaf{i % 30}", 0, "train") for i in range(30) for h in ("h1", "h2")] + [(99, "h1", "h2", 0, "train"), (100, None, "h1", 0, "train")], SCHEMA)
    one = graph.walked(graph.with_ends(twins.filter("pair_id = 99")).select("x", "y"), graph.simple_edges(twins, "", loops=False), 7)
    assert one.filter("n like 'leaf%'").count() == 30
    assert by_id(graph.triangles(twins))[99]["triangles"] == 30


def test_cliques_match_brute_force(spark):
    import itertools

    rng = random.Random(4)
    for n, share in ((9, 0.7), (14, 0.5), (40, 0.15)):
        edges = [(f"n{i}", f"n{j}") for i in range(n) for j in range(i) if rng.random() < share]
        near = {x: {a if b == x else b for a, b in edges if x in (a, b)} for e in edges for x in e}

        def grown(clique, free):
            return max([len(clique), *(grown(clique | {v}, free & near[v]) for v in free if v > max(clique - set(pair), default=""))])

        pairs = spark.createDataFrame([(i, a, b, 0, "train") for i, (a, b) in enumerate(edges)] + [(9999, "n0", "n0", 0, "train")], SCHEMA)
        got = by_id(graph.clique_size(pairs))
        for i, pair in enumerate(edges):
            assert got[i]["clique_size"] == grown(set(pair), near[pair[0]] & near[pair[1]])
        assert got[9999]["clique_size"] == -1
        levels = {r["node"]: r["level"] for r in graph.peeled(graph.simple_edges(pairs, "", loops=False)).collect()}
        assert levels.keys() == near.keys() and min(levels.values()) == 0
    # a node that loses all its neighbours in one round has a level, too
    star = spark.createDataFrame([(i, "hub", f"l{i}", 0, "train") for i in range(20)] + [(99, "a", "b", 0, "train")], SCHEMA)
    assert {r["node"]: r["level"] for r in graph.peeled(graph.simple_edges(star, "", loops=False)).collect()}.keys() == {"hub", "a", "b", *(f"l{i}" for i in range(20))}
    # a full graph of 40 nodes: no recursion, one clique settles it
    whole = [((1 << 40) - 1) ^ 1 << i for i in range(40)]
    assert set(graph.edge_cliques(whole).values()) == {40}
    assert sum(1 for a, b in itertools.combinations(range(40), 2)) == len(graph.edge_cliques(whole))


def test_transitivity_of_null_and_equal_questions(spark):
    rows = [(1, "a", "c", 1, "train", None), (2, "b", "c", 1, "train", None), (3, "a", "b", None, "test", 0.4), (4, None, "a", None, "test", 0.4), (5, "a", "a", None, "test", 0.4)]
    got = {r["pair_id"]: r["p"] for r in postprocess.transitivity(spark.createDataFrame(rows, SCHEMA + ", p double"), rounds=1).collect()}
    assert got[3] == pytest.approx(0.6) and got[4] == 0.4 and got[5] == pytest.approx(0.6)


def test_dictionary_tables_match_lookups(spark, tmp_path):
    (tmp_path / "n.json").write_text('{"cat": ["feline", "kitty"], "dog": ["hound"], "unused": ["other"]}')
    (tmp_path / "v.json").write_text('{"sleep": ["doze"], "cat": ["dog"]}')
    nouns, verbs = (sources.read_dictionary(spark, str(tmp_path / f"{k}.json"), k) for k in "nv")
    loose = spark.createDataFrame([("big", "large"), ("ran", "sleep")], "word string, other string")
    tag = {"cat": "NN", "feline": "NNS", "dog": "NN", "hound": "NN", "sleep": "VB", "doze": "VBD", "big": "JJ", "large": "JJ", "ran": "VBD"}
    token = lambda w, i: {"word": w, "pos": tag.get(w, "IN"), "ner": "O", "deps": {i - 1: "x"} if i else {}}
    texts = [("big cat sleep", "large feline doze"), ("feline ran", "cat sleep"), ("dog cat", "cat dog"), ("hound", ""), ("hound of cat", "dog of kitty")]
    annotated = spark.createDataFrame([(i, *[[token(w, k) for k, w in enumerate(x.split())] for x in pair]) for i, pair in enumerate(texts)], f"pair_id bigint, s {sources.SENTENCE}, t {sources.SENTENCE}")
    plain = alignment.Similarity({("n", "cat", "feline"), ("n", "cat", "kitty"), ("n", "dog", "hound"), ("v", "sleep", "doze"), ("v", "cat", "dog")}, {("big", "large"), ("ran", "sleep")})
    want = by_id(alignment.alignment_features(annotated, plain))
    got = by_id(alignment.alignment_features(annotated, synonyms=nouns.union(verbs), paraphrases=loose))
    assert got == want and got[0]["sem_sim"] == 1.0 and got[1]["sem_sim"] == 1.0
    known = by_id(alignment.known_pairs(annotated, nouns.union(verbs), loose))
    assert sorted(map(tuple, known[0]["known"])) == [("", "big", "large"), ("n", "cat", "feline"), ("v", "sleep", "doze")] and 2 not in known
    assert by_id(alignment.alignment_features(annotated, paraphrases=loose))[0]["S_sem_sim"] is not None
