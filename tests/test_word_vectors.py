"""Co-occurrence, positive PMI and the randomized SVD against plain arrays."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cometa.operators import embed_cache as ec
from cometa.operators import mlprep as mp
from cometa.operators import word_vectors as wv


def table(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)


def test_pairs_equal_plain_counts(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(rng.randrange(0, 30))) for _ in range(60)] + [None, "", "a", "a a a", "A, b! a"]
    df = table(spark, texts)
    vocab = mp.fit_vocabulary(df, "text", 7)  # five tokens of seven
    ids = {r.token: r.id for r in vocab.collect()}
    want = Counter()
    for t in texts:
        w = [x for x in (t or "").lower().replace(",", "").replace("!", "").split()]
        for d in (1, 2, 3):
            for x, y in zip(w, w[d:]):
                if x in ids and y in ids:
                    want[ids[x], ids[y]] += 1
                    want[ids[y], ids[x]] += 1
    counts = wv.cooccurrences(df, "text", vocab, 3)
    assert {(r.a, r.b): r.n for r in counts.collect()} == dict(want)
    own, total = Counter(), sum(want.values())
    for (a, _), n in want.items():
        own[a] += n
    got = {(r.a, r.b): r.weight for r in wv.positive_pmi(counts).collect()}
    pmi = {k: math.log(n * total / (own[k[0]] * own[k[1]])) for k, n in want.items()}
    assert got.keys() == {k for k, v in pmi.items() if v > 0} and all(abs(got[k] - pmi[k]) < 1e-9 for k in got)


def matrix(spark, m):
    a, b = np.nonzero(m)
    return spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(a, b)], "a int, b int, weight double").repartition(4)


def test_product_and_factors_of_a_known_matrix(spark):
    rng = np.random.default_rng(2)
    basis = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    values = np.r_[9.0, -7.0, 5.0, 3.0, rng.normal(size=36) * 0.01]
    m = basis @ np.diag(values) @ basis.T
    t = matrix(spark, m)
    block = rng.normal(size=(40, 6))
    assert np.allclose(wv.product(t, block), m @ block)
    columns, found = wv.randomized_svd(t, 40, dim=4, extra=6)
    assert np.allclose(found, values[:4], atol=1e-6)
    assert np.allclose(columns.T @ columns, np.eye(4), atol=1e-9)
    assert np.abs(columns @ np.diag(found) @ columns.T - m).max() < 0.06
    assert np.allclose(np.abs(np.sum(columns * basis[:, :4], axis=0)), 1, atol=1e-6)


def test_words_of_one_topic_are_neighbours(spark):
    rng = random.Random(3)
    topics = [["cat", "dog", "bird", "fish"], ["red", "blue", "green", "pink"], ["one", "two", "three", "four"]]
    df = table(spark, [" ".join(rng.choice(topics[k % 3]) for _ in range(30)) for k in range(90)])
    vectors = wv.learn_word_vectors(df, "text", 14, 3, 6).cache()
    assert vectors.count() == 12
    near = wv.nearest_words(vectors, [w for t in topics for w in t], 3).collect()
    home = {w: k for k, t in enumerate(topics) for w in t}
    assert len(near) == 36 and all(home[r.word] == home[r.neighbour] for r in near)


def test_texts_are_embedded_through_the_cache(spark, tmp_path):
    rng = random.Random(4)
    topics = [["cat", "dog", "bird"], ["red", "blue", "green"]]
    texts = [" ".join(rng.choice(topics[k % 2]) for _ in range(12)) for k in range(40)]
    vectors = wv.learn_word_vectors(table(spark, texts), "text", 8, 3, 4)
    df = spark.createDataFrame(list(enumerate([*texts, None, "unknown words"])), "k int, text string")
    out = {r.k: r.embedding for r in ec.embed_with_cache(df, "text", str(tmp_path / "c"), embedder=wv.learned_embedder(vectors), model="word-vectors").collect()}
    assert out[40] is None and out[41] == [0.0] * 4
    x = np.array([out[k] for k in range(40)])
    assert np.allclose(np.linalg.norm(x, axis=1), 1, atol=1e-5)
    alike = x @ x.T
    assert alike[::2, ::2].min() > alike[::2, 1::2].max()


def test_empty_texts(spark):
    assert wv.learn_word_vectors(table(spark, [None, ""]), "text", 10, 2, 4).collect() == []
    one = wv.learn_word_vectors(table(spark, ["a"]), "text", 10, 2, 4).collect()
    assert [r.token for r in one] == ["a"] and np.isfinite(one[0].vector).all()
