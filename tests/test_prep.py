"""Preparation, encoder, embedder and model-utility contracts (P2, P8, P9,
J3, E3, E6, M9, A11/A12 on a fitted model)."""

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cometa.operators import mlprep as mp
from cometa.operators import models as md
from cometa.operators.embed_cache import embed_with_cache, pandas_embedder
from cometa.operators.validate import audit, resolve_roles
from tests.conftest import SF001


def test_role_resolution_first_and_last_match():
    cols = ["Nº_Serie", "Nota_leit", "Comentleitura", "Nota_leitura_2", "Coment_extra", "ANÁLISE", "analise_2"]
    assert resolve_roles(cols) == ("Nota_leit", "Comentleitura", "ANÁLISE")
    # legacy table-level mode: the last matching nota/comment column wins
    assert resolve_roles(cols, legacy_last_match=True) == ("Nota_leitura_2", "Coment_extra", "ANÁLISE")
    assert resolve_roles(["a", "b"]) == (None, None, None)


def test_audit_resolves_roles_and_raises_without_them(spark):
    df = spark.createDataFrame([("B111", "12345 67890")], "Nota_leit string, Comentleitura string")
    assert audit(df).first()["ANÁLISE"] == "C"
    with pytest.raises(ValueError):
        audit(spark.createDataFrame([("x",)], "a string"))


def test_fill_sentinel_and_text_cast(spark):
    df = spark.createDataFrame([(1, None, None), (None, 2.0, "t")], "a int, b double, c string")
    out = mp.fill_sentinel(df, ["a", "b"]).orderBy("c").collect()
    assert [(r.a, r.b, r.c) for r in out] == [(1, -1.0, None), (-1, 2.0, "t")]
    texts = [r[0] for r in df.select(mp.as_text(F.col("c"))).collect()]
    assert sorted(texts) == ["nan", "t"]
    train, todo = mp.split_labelled(df, "c")
    assert train.count() == 1 and todo.count() == 1


def test_decode_labels_and_one_hot_encoder(spark):
    lab = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "y string")
    classes = mp.class_table(lab, "y")
    assert [tuple(r) for r in classes.orderBy("idx").collect()] == [("a", 0), ("b", 1), ("c", 2)]
    ids = spark.createDataFrame([(0,), (2,), (7,)], "i int")
    got = {r.i: r.name for r in mp.decode_labels(ids, "i", classes, "name").collect()}
    assert got == {0: "a", 2: "c", 7: None}
    enc = mp.one_hot_encoder("i", "v").fit(spark.createDataFrame([(0.0,), (1.0,), (2.0,)], "i double"))
    vecs = enc.transform(spark.createDataFrame([(1.0,)], "i double")).select(vector_to_array("v").alias("a")).first()
    # dropLast=False keeps every class; handleInvalid="keep" adds one slot for unseen values
    assert list(vecs.a) == [0.0, 1.0, 0.0, 0.0]


def _len_embedder(texts):
    return [[float(len(t)), float(t.count(" "))] for t in texts]


def test_pandas_embedder_embeds_only_cache_misses(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b"), (2, "ccc"), (3, "a b"), (4, None)], "id int, text string")
    emb = pandas_embedder(_len_embedder, dim=2, model="len")
    cache = str(tmp_path / "cache")
    out = {r.id: r.embedding for r in embed_with_cache(df, "text", cache, embedder=emb, model="len").collect()}
    assert out[1] == [3.0, 1.0] and out[3] == [3.0, 1.0] and out[2] == [3.0, 0.0] and out[4] is None
    assert spark.read.parquet(cache).count() == 2  # distinct texts only
    more = spark.createDataFrame([(5, "ccc"), (6, "dd dd")], "id int, text string")
    again = {r.id: r.embedding for r in embed_with_cache(more, "text", cache, embedder=emb, model="len").collect()}
    assert again == {5: [3.0, 0.0], 6: [5.0, 1.0]}
    assert spark.read.parquet(cache).count() == 3  # only the miss was appended


def test_training_history_and_evaluate(spark):
    e = spark.read.parquet(f"{SF001}/embeddings.parquet").withColumn("label", F.col("label").cast("string"))
    split = mp.stratified_split(mp.drop_rare_classes(e, "label"), "label", "vec_id", 0.8, seed=42)
    train, val = split.where("split = 'train'"), split.where("split = 'val'")
    model = md.fit_vector_classifier(train, "embedding", "label", max_iter=20)
    hist = [r.loss for r in md.training_history(model).orderBy("iteration").collect()]
    assert len(hist) >= 2 and hist[-1] <= hist[0]
    rep, avg = md.evaluate(model, md.vectorize(val, "embedding"), "label")
    a = avg.first()
    assert a.n == val.count()
    assert 0.0 <= a.accuracy <= 1.0 and 0.0 <= a.macro_f1 <= 1.0
    assert rep.agg(F.sum("support")).first()[0] == val.count()
