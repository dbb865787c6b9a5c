"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; ``run`` writes every stage's result as Parquet and reads it back as the next
one's input. All but the last return the columns of ``documents``.

1. toxicity: rows that the classifier predicts toxic go.
2. near copies: of documents linked at Jaccard 0.8 or above, the one with the
   least doc_id stays (a null doc_id comes last).
3. secrets: every span found is replaced by [SECRET]; the row stays.
4. mixing: a source over its target loses documents, one under it repeats them
   whole; the document at a source's cut is kept whole. Each repeat is a row.
5. pieces: token ids of each row, with their digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cometa.llm import chosen_path, mixing, pieces, secrets, toxicity
from cometa.llm.common import documents, save


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_civil(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return chosen_path.keep_one(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", civil),
    ("near copies", one_of_each),
    ("secrets", without_secrets),
    ("mixing", mixed),
    ("pieces", encoded),
]

# Classifiers and token ids can't be written in SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"pipeline_{name.replace(' ', '_')}")
    return STAGES[-1][1](spark, docs, sf_dir)
