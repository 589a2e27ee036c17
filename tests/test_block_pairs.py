"""Distances of all pairs of a block against the pair by pair form, with blocks far over the three next documents."""

import pytest
from pyspark.sql import functions as F

from pairloom.operators import block_pairs, vector_features
from pairloom.plans import registry

WORDS = "walking walked walks talking talked talks jumping jumped jumps oak elm ash".split()


def texts():
    """A block of 30, one of 6 and single ones; ids with gaps, two neighbours in one block and others across blocks; an empty text."""
    heads = ["big block"] * 30 + ["Small Block"] * 6 + [f"only{i} one" for i in range(4)] + [""]
    return [(i * 3 % 41 + (i % 5 == 0) * 100, head + "".join(f" {WORDS[(i * 5 + k * k) % 12]}" for k in range(i % 9)) if head else "") for i, head in enumerate(heads)]


def every_pair(rows):
    key = lambda t: tuple(t.lower().split()[:2])
    return [(a * 10**9 + b, s, t, 0, "train") for a, s in rows for b, t in rows if a < b and (key(s) == key(t) or b == a + 1)]


@pytest.mark.parametrize("cell", [1000, 7])
def test_all_pairs_of_a_block_are_measured(spark, tmp_path, cell):
    rows = texts()
    assert len({r[0] for r in rows}) == len(rows)
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    pairs = every_pair(rows)
    assert len(pairs) > 30 * 29 // 2 + 6 * 5 // 2
    plain = vector_features.learned_lemma_distance_features(spark.createDataFrame(pairs, "pair_id bigint, question1 string, question2 string, is_duplicate int, split string"), prefix="lemma")
    want = {r["pair_id"]: r for r in registry.rounded(plain).collect()}
    questions = registry.questions_from_documents(spark, str(tmp_path))
    got = (registry.queries()["pair_learned_lemma_distances"](spark, str(tmp_path)) if cell == 1000 else registry.rounded(block_pairs.lemma_distances(questions, cell=cell))).collect()
    assert len(got) == len(want) == len({r["pair_id"] for r in got})
    for r in got:
        for c in want[r["pair_id"]].asDict():
            assert r[c] == pytest.approx(want[r["pair_id"]][c], abs=2e-6)


def test_a_question_without_a_block_meets_its_neighbours(spark):
    rows = [(1, "a b oak", "a b"), (2, None, None), (3, None, None), (4, "a b oak", "a b"), (9, "c d", "c d")]
    got = block_pairs.lemma_distances(spark.createDataFrame(rows, "doc_id bigint, question string, blk string")).select("pair_id", F.round("lemma_tfidf_cosine", 6)).collect()
    assert {r[0]: r[1] for r in got} == {1 * 10**9 + 2: 0.0, 2 * 10**9 + 3: 0.0, 3 * 10**9 + 4: 0.0, 1 * 10**9 + 4: 0.0}
