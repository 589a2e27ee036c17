"""A tagger that reads each text once."""

from pairloom.operators import tagging


def test_equal_texts_are_read_once_by_the_tagger(spark, monkeypatch):
    kept = {}

    def table(df, label, real=tagging.shared_table):
        kept[label] = real(df, label)
        return kept[label]

    monkeypatch.setattr(tagging, "shared_table", table)
    texts = ["a dog is walking"] * 40 + ["the cat", None, ""]
    model = tagging.train_tagger(spark.createDataFrame([(t,) for t in texts], "text string"), "text", rounds=1)
    assert sorted(r["n"] for r in kept["encoded"].collect()) == [1, 40]
    assert model.number["dog"] and model.likelihood[0] < 0
