"""Text embeddings with an incremental cache.

Only texts missing from the cache are embedded: distinct texts (partially
aggregated, so a text repeated by a third of the rows costs one row per
task) are anti-joined with the cache table, the misses are embedded, appended
to the cache, and the vectors are joined back by text key.

The embedder is pluggable. The default is feature hashing (as ``HashingTF``
does, over tokens and token bigrams, L2-normalized), deterministic
and offline; :func:`pandas_embedder` wraps any batch function
``pandas.Series[str] -> list[list[float]]`` (e.g. a local transformer model)
as an Arrow-batched ``mapInPandas`` over the misses only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cometa.functions.grams import hashed_counts
from cometa.session import materialize

CACHE_COLUMNS = ["model", "text_key", "embedding"]
CACHE_SCHEMA = "model string, text_key string, embedding array<float>, bucket int"
BUCKETS = 64


def text_key(c):
    return F.sha2(c, 256)


def distinct_texts(df: DataFrame, text_col: str) -> DataFrame:
    """(text_key, text, n_docs) per distinct non-null text."""
    t = F.col(text_col)
    return (
        df.where(t.isNotNull())
        .groupBy(text_key(t).alias("text_key"))
        .agg(F.first(t).alias("text"), F.count(F.lit(1)).alias("n_docs"))
    )


def cache_misses(df: DataFrame, text_col: str, cached_keys: DataFrame) -> DataFrame:
    """Distinct texts whose key is not in ``cached_keys(text_key)``."""
    keys = cached_keys.select("text_key").distinct()
    return distinct_texts(df, text_col).join(keys, "text_key", "left_anti").select("text_key", "n_docs")


def hashed_embedder(dim: int = 768, model: str = "hashed-ngrams") -> Callable[[DataFrame], DataFrame]:
    """Default embedder: (text_key, text) -> (model, text_key, embedding)."""

    def embed(texts: DataFrame) -> DataFrame:
        # the hashed counts of tokens and token bigrams, from the text at once
        tf = texts.withColumn("__tf", hashed_counts(2, dim)("text"))
        nrm = Normalizer(p=2.0, inputCol="__tf", outputCol="__v").transform(tf)
        return nrm.select(
            F.lit(model).alias("model"), "text_key", vector_to_array("__v", "float32").alias("embedding")
        )

    return embed


def pandas_embedder(fn: Callable, dim: int, model: str, batch_rows: int = 32) -> Callable[[DataFrame], DataFrame]:
    """Wrap a batch function ``texts -> vectors`` as an Arrow-batched embedder."""
    import pandas as pd

    def _batches(it):
        for pdf in it:
            for start in range(0, len(pdf), batch_rows):
                part = pdf.iloc[start : start + batch_rows]
                vecs = fn(part["text"])
                yield pd.DataFrame({"model": model, "text_key": part["text_key"].values, "embedding": list(vecs)})

    def embed(texts: DataFrame) -> DataFrame:
        return texts.select("text_key", "text").mapInPandas(
            _batches, "model string, text_key string, embedding array<float>"
        )

    del dim
    return embed


def bucket_of(key, buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def read_cache(spark: SparkSession, cache_path: str, model: str, buckets: list[int] | None = None) -> DataFrame | None:
    """The cache's rows of a model, from the given buckets' folders alone; None if nothing is cached yet."""
    try:
        cache = spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    except AnalysisException:  # the path does not exist
        return None
    cache = cache.where(F.col("model") == model)
    return cache if buckets is None else cache.where(F.col("bucket").isin(buckets))


def embed_with_cache(
    df: DataFrame,
    text_col: str,
    cache_path: str,
    embedder: Callable[[DataFrame], DataFrame] | None = None,
    model: str = "hashed-ngrams",
    out_col: str = "embedding",
) -> DataFrame:
    """Attach ``out_col`` to every row, computing embeddings only for texts
    not yet cached under ``model``; new vectors are appended to the cache
    (a parquet table in a shared folder). A null text gets a null vector.

    The cache is cut into ``BUCKETS`` folders by the key's hash; folders that no
    current key falls into are not opened, so a small table reads little of a large
    cache. Keys are compared before any text is fetched, only the current keys'
    vectors are taken from the cache, and they are written as a plain table
    before the join back, so that adaptive execution may split a text that
    very many rows share. Rows with a null text stay out of the join.
    """
    spark = df.sparkSession
    embedder = embedder or hashed_embedder(model=model)
    key = text_key(F.col(text_col))
    known = df.where(F.col(text_col).isNotNull()).withColumn("__key", key)
    keys = materialize(known.select(F.col("__key").alias("text_key")).distinct().withColumn("bucket", bucket_of("text_key")), "embedding_keys")
    used = sorted(r[0] for r in keys.select("bucket").distinct().collect())  # at most BUCKETS numbers
    cache = read_cache(spark, cache_path, model, used)
    missing = keys if cache is None else keys.join(cache.select("bucket", "text_key"), ["bucket", "text_key"], "left_anti")
    texts = known.select(F.col("__key").alias("text_key"), F.col(text_col).alias("text")).join(missing.select("text_key"), "text_key", "left_semi")
    new = embedder(texts.groupBy("text_key").agg(F.first("text").alias("text")))
    append_vectors(new, cache_path)
    # Concurrent runs may append the same text twice: one vector per key.
    cache = read_cache(spark, cache_path, model, used)
    if cache is None:  # no text at all
        return df.withColumn(out_col, F.lit(None).cast("array<float>"))
    cached = cache.join(keys, ["bucket", "text_key"], "left_semi")
    vectors = materialize(cached.groupBy("text_key").agg(F.first("embedding").alias(out_col)), "embedding_vectors")
    found = known.join(vectors.withColumnRenamed("text_key", "__key"), "__key", "left").drop("__key")
    kind = vectors.schema[out_col].dataType
    return found.unionByName(df.where(F.col(text_col).isNull()).withColumn(out_col, F.lit(None).cast(kind)))


def append_vectors(new: DataFrame, cache_path: str) -> None:
    """Add (model, text_key, embedding) to the cache, a file a bucket and write task; buckets are gathered first."""
    new = new.withColumn("bucket", bucket_of("text_key"))
    new.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(cache_path)


def compact(spark: SparkSession, cache_path: str, least_files: int = 8) -> int:
    """Rewrite each bucket that has ``least_files`` files or more as few files, one vector per (model, key).

    The files listed first are read and written anew, and only then are just these
    removed: what other runs append meanwhile stays, and a run that ends in between
    leaves rows twice, which readers allow for. Returns the number of files removed.
    A reader that has already listed the removed files must list them again.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(f"{cache_path}/bucket=*/*.parquet")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    buckets: dict[str, list] = {}
    for f in fs.globStatus(path) or []:
        buckets.setdefault(f.getPath().getParent().toString(), []).append(f.getPath())
    old = [f for files in buckets.values() if len(files) >= least_files for f in files]
    if not old:
        return 0
    rows = spark.read.schema(CACHE_SCHEMA).option("basePath", cache_path).parquet(*[f.toString() for f in old])
    kept = rows.groupBy("model", "text_key").agg(F.first("embedding").alias("embedding"))
    append_vectors(kept, cache_path)
    for f in old:
        fs.delete(f, False)
    return len(old)
