"""Tokens are looked up inside their rows: the same as by joins, without gathering a row's tokens again."""

import pytest
from pyspark.sql import functions as F

from framewise.operators import textprep as tp


def test_lookup_equals_joins(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "zz", "a", None]), (2, []), (3, None), (4, ["c@@", "b", "c@@"])], "doc long, l array<string>")
    vocab = spark.createDataFrame([("a", 5), ("b", 6), ("c@@", 7), ("odd", None)], "token string, id int")
    near, far = tp.encode(docs, "doc", "l", vocab), tp.encode(docs, "doc", "l", vocab, max_vocab=0)
    assert near.schema["ids"].dataType == far.schema["ids"].dataType
    assert sorted(near.collect()) == sorted(far.collect())
    assert "Generate" not in near._jdf.queryExecution().analyzed().toString()
    ids = spark.createDataFrame([(1, [5, 9, 7, 6, 0]), (2, [0, 0]), (3, []), (4, None), (5, [99]), (6, [6, 7])], "doc long, ids array<long>")
    names = vocab.filter("id is not null").withColumn("id", F.col("id").cast("long"))
    near, far = tp.decode(ids, "doc", "ids", names, 0), tp.decode(ids, "doc", "ids", names, 0, max_vocab=0)
    assert sorted(near.collect()) == sorted(far.collect()) and near.count() == 3
    assert "Generate" not in near._jdf.queryExecution().analyzed().toString()
    with pytest.raises(Exception, match="not in vocabulary: zz"):
        tp.encode(docs, "doc", "l", vocab, unk=None).collect()


def test_wordpiece_in_place_equals_joins(spark):
    names = ["unable", "able", "unx", "", None, "##ab", "\U0001F600é", "a" * 201, "a" * 200, "un", "ablé"]
    words = spark.createDataFrame([(w,) for w in names], "word string")
    vocab = spark.createDataFrame([(t,) for t in ["un", "##able", "able", "##a", "a", "\U0001F600", "##é", "##ab", "##l", "#", "###"]], "token string")
    near, far = tp.wordpiece(words, vocab), tp.wordpiece(words, vocab, max_vocab=0)
    order = lambda df: sorted(map(repr, df.collect()))
    assert order(near) == order(far)
    assert "Generate" not in near._jdf.queryExecution().analyzed().toString()


def test_features_of_a_large_vocabulary_are_looked_up_in_place(spark, monkeypatch):
    """Over 200,000 tokens every token of every window was dealt, twice, with its row."""
    docs = spark.createDataFrame([(1, ["a", "b", "zz", None]), (2, ["c"]), (3, ["b", "a"])], "doc long, l array<string>")
    vocab = spark.createDataFrame([("a", 5), ("b", 6), ("[SEP]", 7), ("c", None), ("odd", 9)], "token string, id int")

    def features(names):
        return tp.build_features(docs, F.slice("l", 1, 1), F.col("l"), names, 12, ["doc"])

    near = features(vocab)
    monkeypatch.setattr(tp, "LISTED_VOCAB", 0)
    hashed = features(vocab)
    assert not any(x in hashed._jdf.queryExecution().analyzed().toString() for x in ("Generate", "Join"))
    repeated = features(vocab.filter("token = 'a'").unionByName(vocab))  # a repeated token is joined, as before
    assert "Join" in repeated._jdf.queryExecution().analyzed().toString()
    monkeypatch.setattr(tp, "HASHED_VOCAB", 0)
    order = lambda df: sorted(map(repr, df.collect()))
    assert order(near) == order(hashed) == order(features(vocab)) and near.schema == hashed.schema
