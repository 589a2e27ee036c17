"""The blocks of the out-of-fold family: term counts, their differences, SVD coordinates and lemma tf-idf of pairs."""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from pairloom.functions.text import split_words
from pairloom.operators import modeling
from pairloom.operators.spectral import BUCKETS, bucket
from pairloom.operators.vector_features import lemmas, sides, svd_points, weighted_terms
from pairloom.sources.tables import shared_table

#: Rows of a regression's task: a step of a fit sends a sum of all coefficients from each task, which is dearer than so many short rows.
TASK_ROWS = 25_000
KEEP = ["pair_id", "split", "is_duplicate"]


def sparse_rows(terms: DataFrame, width: int) -> DataFrame:
    """(pair_id, features) from (pair_id, at, weight): weights of a place are summed; the layout is that of a sparse vector."""
    sums = terms.groupBy("pair_id", "at").agg(F.sum("weight").alias("weight")).filter("weight <> 0")
    lists = sums.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("at", "weight"))).alias("x"))
    return lists.select("pair_id", _layout(F.col("x.at"), F.col("x.weight"), width).alias("features"))


def _layout(at: Column, weight: Column, width: int) -> Column:
    return F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(width).alias("size"), at.cast("array<int>").alias("indices"), weight.cast("array<double>").alias("values"))


def vectors(pairs: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """pairs (KEEP and fold) with the sparse vector of each; pairs without a term have an empty one."""
    none = F.array().cast("array<int>")
    out = pairs.join(rows, "pair_id", "left").withColumn("features", F.coalesce("features", _layout(none, none, width)))
    plain = [f for f in out.schema if f.name != "features"]
    return shared_table(out.select(*[f.name for f in plain], "features"), "vectors", StructType([*plain, StructField("features", VectorUDT())]))


def blocks(pairs: DataFrame, folds: int = 10, k: int = 100, buckets: int = BUCKETS) -> dict[str, DataFrame]:
    """Each block of modeling.BLOCKS as (pair_id, split, is_duplicate, fold, features). Null questions are empty.

    Terms are hashed into buckets a side. The SVD blocks are the joined coordinates, and product and
    absolute difference of both questions in the shared basis.
    """
    keyed = shared_table(modeling.with_stratified_fold(pairs.select(*KEEP), folds), "keyed")
    words = sides(pairs, "").select("pair_id", "side", F.explode(split_words(F.col("text"))).alias("term"))
    places = shared_table(words.select("pair_id", "side", bucket(F.col("term"), buckets).alias("at")), "places")
    beside = F.col("at") + (F.col("side") - 1) * buckets
    lemma = weighted_terms(pairs, lemmas, "").select("pair_id", "side", bucket(F.col("term"), buckets).alias("at"), "weight")
    points = keyed.join(shared_table(svd_points(pairs, k, buckets), "svd_points"), "pair_id")  # three blocks read them
    dense = lambda c: points.select(*KEEP, "fold", array_to_vector(c).alias("features"))
    return {
        "tf": vectors(keyed, sparse_rows(places.select("pair_id", beside.alias("at"), F.lit(1.0).alias("weight")), 2 * buckets), 2 * buckets),
        "tf_svd100": dense(F.col("joint")),
        "diff_tf": vectors(keyed, sparse_rows(places.select("pair_id", "at", (3.0 - 2.0 * F.col("side")).alias("weight")), buckets), buckets),
        "svd_mult": dense(F.zip_with("p1", "p2", lambda x, y: x * y)),
        "svd_absdiff": dense(F.zip_with("p1", "p2", lambda x, y: F.abs(x - y))),
        "w1l_tfidf": vectors(keyed, sparse_rows(lemma.select("pair_id", beside.alias("at"), "weight"), 2 * buckets), 2 * buckets),
    }


def regressions(pairs: DataFrame, folds: int = 10, rounds: int = 100, k: int = 100, buckets: int = BUCKETS) -> DataFrame:
    """(pair_id, split, is_duplicate, m_<block>_oof): an elastic-net regression a block and fold."""

    def scores(item: tuple[str, DataFrame]) -> DataFrame:
        mixing, strength, calibrate = modeling.BLOCKS[item[0]]
        return modeling.out_of_fold(item[1], lambda: modeling.logistic(mixing, strength).setMaxIter(rounds), folds, f"m_{item[0]}_oof", calibrate, task_rows=TASK_ROWS, parallel=5)

    with ThreadPool(2) as pool:
        columns = pool.map(scores, blocks(pairs, folds, k, buckets).items(), 1)
    return reduce(lambda a, b: a.join(b.drop("split", "is_duplicate"), "pair_id"), columns)
