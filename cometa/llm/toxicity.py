"""Toxicity: a character n-gram linear classifier with naive Bayes feature scaling.

Texts are lower-cased; n-grams of 3 to 6 characters are hashed to ``BUCKETS``.
On the training rows, every bucket's document counts by class give its log-count
ratio ``r = log((p / |p|) / (q / |q|))`` with one added to each count. The
``FEATURES`` buckets with the largest ``|r| * log(1 + documents)`` are kept, a
document's features are ``r`` where the n-gram is present, and a logistic
regression (elastic net) is fitted on them.

The classifier is fitted on a bounded sample: at most ``PER_CLASS`` labelled
training rows of each class, those with the smallest hash of doc_id; the
intercept is corrected for the share that was left out. Everything else covers
all rows: each whole text is scored where it is read, in NumPy, without a
shuffle. The driver holds ``FEATURES`` rows and a table of ``BUCKETS`` numbers.

Defined results: a null or empty text has no features and is scored by the
intercept; rows with a null label don't train; of several labels or texts with
one doc_id the largest counts; if a class has no training row the score is the
smoothed share of label 1; repeated rows get equal scores; an empty table gives
an empty result. Other columns of the input are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cometa.llm.common import give_back_memory, save

SIZES = (3, 4, 5, 6)
BITS = 20
BUCKETS = 1 << BITS
FEATURES = 5000
PER_CLASS = 8000
LEAST_DOCS = 5
STEP, MIX = np.uint32(0x01000193), np.uint32(0x9E3779B1)


def ngram_buckets(chars: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each character."""
    count = len(chars) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint32)
    h = np.full(count, n, dtype=np.uint32)
    for k in range(n):
        h *= STEP
        h += chars[k : k + count]
    h ^= h >> np.uint32(15)
    h *= MIX
    return h >> np.uint32(32 - BITS)


def characters(text: str) -> np.ndarray:
    return np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), dtype=np.uint32)


@dataclass
class Model:
    """feature: bucket to feature number or -1; weight: of each feature where present."""

    feature: np.ndarray
    weight: np.ndarray
    intercept: float

    def present(self, text: str) -> np.ndarray:
        """The numbers of the features in a text, each once."""
        chars = characters(text)
        found = [f[f >= 0] for f in (self.feature[ngram_buckets(chars, n)] for n in SIZES)]
        return np.unique(np.concatenate(found))

    def score(self, text: str | None) -> float:
        z = self.intercept + (float(self.weight[self.present(text)].sum()) if text else 0.0)
        return 1.0 / (1.0 + math.exp(-z)) if z > -700 else 0.0


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, toxic, text) of the sample, saved; the number of labelled rows of each class outside the held-out fold."""
    own = (
        labels.select(F.col("doc_id").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold(F.col("doc_id")) != 0))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    there = dict(own.groupBy("toxic").count().collect())  # two rows at most
    order = F.xxhash64("doc_id")
    ids = [r for c in (0, 1) for r in own.where(F.col("toxic") == c).orderBy(order, "doc_id").limit(per_class).collect()]
    sample = docs.sparkSession.createDataFrame(ids, own.schema)  # at most 2 * per_class rows
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    return save(texts.groupBy("doc_id", "toxic").agg(F.max("text").alias("text")), "toxic_training"), there


def class_counts(rows: DataFrame) -> DataFrame:
    """bucket, p, q: the documents of label 1 and 0 that hold an n-gram of the bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = np.zeros((2, BUCKETS), dtype=np.int64)
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                here = np.zeros(BUCKETS, dtype=bool)
                chars = characters(text)
                for n in SIZES:
                    here[ngram_buckets(chars, n)] = True
                docs[label] += here
        there = np.flatnonzero(docs.sum(0))
        for at in range(0, len(there), 1 << 16):
            some = there[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(docs[1, some]), pa.array(docs[0, some])], ["bucket", "p", "q"])
        give_back_memory()

    counted = rows.mapInArrow(count, "bucket long, p long, q long")
    return counted.groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, features: int = FEATURES) -> Model:
    rows, there = training_rows(docs, labels, per_class)
    got = dict(rows.groupBy("toxic").count().collect())
    none = np.full(BUCKETS, -1, dtype=np.int16)
    if len(got) < 2:
        p, q = there.get(1, 0) + 1, there.get(0, 0) + 1
        return Model(none, np.zeros(0), math.log(p / q))
    counts = class_counts(rows).where(F.col("p") + F.col("q") >= LEAST_DOCS)
    ratio = F.log((F.col("p") + 1) / (got[1] + 2)) - F.log((F.col("q") + 1) / (got[0] + 2))
    best = (
        counts.select("bucket", ratio.alias("r"), (F.abs(ratio) * F.log1p(F.col("p") + F.col("q"))).alias("use"))
        .orderBy(F.desc("use"), "bucket")
        .limit(features)
        .collect()
    )
    feature = none.copy()
    feature[[b.bucket for b in best]] = np.arange(len(best), dtype=np.int16)
    r = np.array([b.r for b in best])
    if not len(r):
        return Model(none, np.zeros(0), math.log((there[1] + 1) / (there[0] + 1)))
    plain = Model(feature, r, 0.0)

    @F.udf(VectorUDT())
    def vector(text):
        at = plain.present(text)
        return SparseVector(len(r), at, r[at])

    training = rows.select(vector("text").alias("features"), F.col("toxic").cast("double").alias("label"))
    model = LogisticRegression(maxIter=60, regParam=0.002, elasticNetParam=0.5, standardization=False).fit(save(training, "toxic_vectors"))
    # classes were sampled at different rates; the odds are put back
    shift = math.log((there[1] / got[1]) / (there[0] / got[0]))
    return Model(feature, model.coefficients.toArray() * r, model.intercept + shift)


def score_column(model: Model, text: Column) -> Column:
    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for one in texts:
            yield one.map(model.score).astype(float) if len(one) else pd.Series([], dtype=float)
        give_back_memory()

    return score(F.coalesce(text, F.lit("")))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = docs.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), score_column(fit(docs, labels), F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_civil(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, unchanged."""
    return docs.where(score_column(fit(docs, labels), F.col("text")) < 0.5)
