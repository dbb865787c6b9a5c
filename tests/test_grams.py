"""Hashed n-gram counts against MLlib's, and what a training runs."""

from pyspark.ml.feature import HashingTF, NGram
from pyspark.sql import functions as F

from cometa.functions.grams import hashed_counts
from cometa.operators import mlprep as mp
from cometa.operators import models as md

TEXTS = ["Hello, World! hello world a b c", None, "", "um", "não há ligação É ² x\x0by\x0cz w ''", "... !!", "Z" * 5000 + " b", "a b", "É-é 日本 語, 語\r\n語"]


def test_counts_equal_mllib(spark):
    d = spark.createDataFrame([(t,) for t in TEXTS], "text string").coalesce(1)
    for longest, size in ((3, 1 << 14), (2, 768)):
        x = d.withColumn("g1", mp.tokenize(F.coalesce("text", F.lit(""))))
        for n in range(2, longest + 1):
            x = NGram(n=n, inputCol="g1", outputCol=f"g{n}").transform(x)
        x = x.withColumn("all", F.concat(*[f"g{n}" for n in range(1, longest + 1)]))
        x = HashingTF(numFeatures=size, inputCol="all", outputCol="want").transform(x)
        rows = x.select("want", hashed_counts(longest, size)("text").alias("got")).collect()
        assert len(rows) == len(TEXTS) and all(r.want == r.got for r in rows)


def test_text_features_make_no_strings_of_ngrams():
    assert not any(isinstance(s, (NGram, HashingTF)) for s in md.text_feature_stages("text"))


def test_a_written_split_is_not_dealt_by_class(spark):
    rows = spark.createDataFrame([(i, "xy"[i % 2], "t" * 50) for i in range(100)], "k int, c string, text string")
    lazy, split = (mp.stratified_split(rows, "c", "k", written=w) for w in (False, True))
    plan = split._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan  # the classes' last rows are a written table
    assert sorted(split.collect()) == sorted(lazy.collect())
