"""Stop words are looked up in a set."""

from pyspark.sql import functions as F

from pairloom.functions.text import STOPWORDS, without_stops


def test_stop_words_are_a_set(spark):
    df = spark.createDataFrame([(["the", "Dog", "is", "is", "dog"],), ([],), (None,)], "t array<string>").select(without_stops(F.col("t")).alias("t"))
    assert [r["t"] for r in df.collect()] == [["Dog", "dog"], [], None]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "INSET" in plan and "array_contains" not in plan and len(STOPWORDS) > 100
