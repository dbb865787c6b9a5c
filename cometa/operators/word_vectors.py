"""Word vectors learned from the texts themselves (E6): co-occurrence, positive PMI, randomized SVD.

1. Pairs of tokens at most ``window`` apart are counted, whole texts, without regard
   to their order, for the tokens of a vocabulary (E5).
2. A pair's weight is its positive pointwise mutual information,
   ``max(0, ln(n_ab * N / (n_a * n_b)))`` with the pairs' own marginal sums.
3. The symmetric weight matrix is factored by a randomized SVD: a random block of
   ``dim + extra`` columns is multiplied by the matrix a few times and made orthonormal
   after each product, then the matrix is solved inside the space found.

Scale: a task reads its texts once, holds the vocabulary and adds its pairs up by the
places of their tokens; the tasks' sums are one aggregation. A product
sends each task's partial sums of the rows it has met; the block, vocabulary x columns
numbers, is all that the driver holds, and the parameters fix its size. The matrix
itself stays a table, written once.

The text embedder averages the vectors of a text's tokens; it can be plugged into the
embedding cache in place of hashed tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cometa.functions import grams
from cometa.operators.mlprep import fit_vocabulary, tokenize
from cometa.plans.joins import lookup_join
from cometa.session import materialize

WINDOW = 4
DIM = 64
EXTRA = 10
ROUNDS = 4
HELD_CHUNKS = 64  # chunks of text whose pairs are added up at once
HELD_PAIRS = 1 << 21  # unlike pairs that a task holds


def cooccurrences(df: DataFrame, text_col: str, vocab: DataFrame, window: int = WINDOW) -> DataFrame:
    """(a, b, n): how often two tokens of ``vocab`` (token, id) stand at most ``window`` apart; ids, both orders, a token beside itself twice."""
    known = vocab.select("token", "id").collect()  # the vocabulary, whose size a parameter fixes
    names = {r.token.encode(): k for k, r in enumerate(known)}
    given = df.sparkSession.sparkContext.broadcast((names, np.array([r.id for r in known], np.int64)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, ids = given.value
        total, held = _summed([]), []

        def rows(total: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
            a, b = ids[total[0] // max(len(ids), 1)], ids[total[0] % max(len(ids), 1)]
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(total[1])], ["a", "b", "n"])

        for batch in batches:
            for part in grams.chunks(batch.column("t")):
                held.append(_pairs([grams.tokens(x) for x in part], place, window))
                if len(held) == HELD_CHUNKS:
                    total, held = _summed([total, *held]), []
                    if len(total[0]) > HELD_PAIRS:
                        yield rows(total)
                        total = _summed([])
        yield rows(_summed([total, *held]))

    pairs = df.select(F.col(text_col).cast("string").alias("t")).mapInArrow(count, "a long, b long, n long")
    both = pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p"), "n")
    kind = vocab.schema["id"].dataType
    return both.groupBy(F.col("p.a").cast(kind).alias("a"), F.col("p.b").cast(kind).alias("b")).agg(F.sum("n").alias("n"))


def _pairs(lists: list[list[bytes]], place: dict[bytes, int], window: int) -> tuple[np.ndarray, np.ndarray]:
    """(lesser place * size of the vocabulary + greater place, how often) of the texts' near tokens; tokens of no place keep theirs in the text."""
    token = np.fromiter((place.get(t, -1) for x in lists for t in x), np.int64)
    text = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    keys = []
    for d in range(1, window + 1):
        x, y = token[:-d], token[d:]
        both = (text[:-d] == text[d:]) & (x >= 0) & (y >= 0)
        keys.append(np.minimum(x, y)[both] * len(place) + np.maximum(x, y)[both])
    return np.unique(np.concatenate(keys), return_counts=True)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys that may repeat among the parts, once each, with the sum of their counts."""
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def positive_pmi(counts: DataFrame) -> DataFrame:
    """(a, b, n, weight) of the pairs whose weight is above 0."""
    counts = materialize(counts, "cooccurrences")
    own = counts.groupBy("a").agg(F.sum("n").alias("na"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    joined = lookup_join(counts, own, "a", how="inner")
    joined = lookup_join(joined, own.withColumnsRenamed({"a": "b", "na": "nb"}), "b", how="inner")
    weight = F.log(F.col("n").cast("double") * F.lit(float(total)) / (F.col("na").cast("double") * F.col("nb").cast("double")))
    return joined.select("a", "b", "n", weight.alias("weight")).where(F.col("weight") > 0)


def product(matrix: DataFrame, block: np.ndarray) -> np.ndarray:
    """The matrix (a, b, weight; ids are places) times a dense block."""
    given = matrix.sparkSession.sparkContext.broadcast(block)  # vocabulary x columns

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = given.value
        out, met = np.zeros_like(q), np.zeros(len(q), bool)
        for batch in batches:
            a, b, w = (batch.column(c).to_numpy() for c in ("a", "b", "weight"))
            met[a] = True
            order = np.argsort(a, kind="stable")
            rows, first = np.unique(a[order], return_index=True)
            for at in range(0, len(rows), 4096):  # a few rows' terms at a time
                i, j = first[at], first[at + 4096] if at + 4096 < len(rows) else len(a)
                some = order[i:j]
                out[rows[at : at + 4096]] += np.add.reduceat(w[some, None] * q[b[some]], first[at : at + 4096] - i, axis=0)
        rows = np.flatnonzero(met)
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(list(out[rows]), pa.list_(pa.float64()))], ["a", "y"])

    columns = block.shape[1]
    partial = matrix.select("a", "b", "weight").mapInArrow(add, "a long, y array<double>")
    sums = partial.groupBy("a").agg(F.array(*[F.sum(F.get("y", F.lit(k))) for k in range(columns)]).alias("y")).toArrow()
    out = np.zeros_like(block)
    if sums.num_rows:
        out[sums.column("a").to_numpy()] = np.stack(sums.column("y").combine_chunks().flatten().to_numpy().reshape(-1, columns))
    return out


def randomized_svd(matrix: DataFrame, size: int, dim: int = DIM, extra: int = EXTRA, rounds: int = ROUNDS, seed: int = 17) -> tuple[np.ndarray, np.ndarray]:
    """(orthonormal columns, signed values) of the ``dim`` largest factors, by size, of a symmetric matrix of ``size`` rows."""
    dim = min(dim, size)
    q = np.random.default_rng(seed).normal(size=(size, min(size, dim + extra)))
    q = np.linalg.qr(q)[0]
    for _ in range(rounds):
        q = np.linalg.qr(product(matrix, q))[0]
    small = q.T @ product(matrix, q)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-np.abs(values), kind="stable")[:dim]
    columns = q @ turn[:, order]
    sign = np.sign(columns[np.abs(columns).argmax(axis=0), np.arange(len(order))])  # the largest entry of a factor is positive
    return columns * np.where(sign == 0, 1, sign), values[order]


def learn_word_vectors(df: DataFrame, text_col: str, max_tokens: int = 5000, window: int = WINDOW, dim: int = DIM) -> DataFrame:
    """(token, id, factors, vector): each vocabulary token's row of the orthonormal factors, and the same scaled by the roots of their values, at unit length."""
    vocab = materialize(fit_vocabulary(df, text_col, max_tokens).select("token", (F.col("id") - 2).alias("id")), "word_vocabulary")
    size = vocab.count()
    matrix = materialize(positive_pmi(cooccurrences(df, text_col, vocab, window)), "word_weights")
    if not size:
        return vocab.select("token", "id", F.array().cast("array<double>").alias("factors"), F.array().cast("array<double>").alias("vector"))
    columns, values = randomized_svd(matrix, size, dim)
    vectors = columns * np.sqrt(np.abs(values))
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    kind = pa.list_(pa.float64())
    table = pa.table({"id": np.arange(size, dtype=np.int32), "factors": pa.array(list(columns), kind), "vector": pa.array(list(vectors), kind)})
    return vocab.join(df.sparkSession.createDataFrame(table), "id").select("token", "id", "factors", "vector")


def nearest_words(vectors: DataFrame, words: list[str], k: int = 5) -> DataFrame:
    """word, neighbour, similarity: the ``k`` nearest of the vocabulary to each given word."""
    own = vectors.where(F.col("token").isin(words)).select(F.col("token").alias("word"), F.col("vector").alias("v"))
    dot = F.aggregate(F.zip_with("v", "vector", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    pairs = vectors.join(F.broadcast(own), F.col("token") != F.col("word")).select("word", F.col("token").alias("neighbour"), dot.alias("similarity"))
    best = pairs.groupBy("word").agg(F.slice(F.sort_array(F.collect_list(F.struct("similarity", "neighbour")), asc=False), 1, k).alias("n"))
    return best.select("word", F.explode("n").alias("n")).select("word", "n.neighbour", "n.similarity")


def learned_embedder(vectors: DataFrame, model: str = "word-vectors") -> Callable[[DataFrame], DataFrame]:
    """An embedder for ``embed_with_cache``: the mean vector of a text's known tokens, at unit length (zeros if none is known)."""
    rows = vectors.select("token", "vector").collect()  # the vocabulary, whose size a parameter fixes
    given = vectors.sparkSession.sparkContext.broadcast(({r.token: k for k, r in enumerate(rows)}, np.array([r.vector for r in rows], np.float32)))

    def embed(texts: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            place, table = given.value
            for batch in batches:
                lists = [[place[t] for t in x if t in place] for x in batch.column("t").to_pylist()]
                means = [table[x].mean(axis=0) if x else np.zeros(table.shape[1], np.float32) for x in lists]
                means = [m / max(float(np.linalg.norm(m)), 1e-12) for m in means]
                columns = [pa.array([model] * len(means)), batch.column("text_key"), pa.array([m.tolist() for m in means], pa.list_(pa.float32()))]
                yield pa.RecordBatch.from_arrays(columns, ["model", "text_key", "embedding"])

        return texts.select("text_key", tokenize(F.col("text")).alias("t")).mapInArrow(run, "model string, text_key string, embedding array<float>")

    return embed
