"""The registered query of each operator, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cometa.llm import box_codes, chosen_path, hamming_search, mixing, phrase_dedup, phrase_mining, pieces, quality, secrets, sharding, suffix_dedup, toxicity, wavelet
from cometa.llm.common import documents


def _on_documents(query: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(documents(spark, sf_dir))


def _toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.query(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"))


def _search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_search.query(spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet"))


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return box_codes.query(spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_encode_pieces": _on_documents(pieces.query),
    "op2_scan_secrets": _on_documents(secrets.query),
    "op3_dedup_suffixes": _on_documents(suffix_dedup.query),
    "op4_search_hamming": _search,
    "op5_judge_quality": _on_documents(quality.query),
    "op6_join_jaccard": _on_documents(chosen_path.query),
    "op7_mix_sources": _on_documents(mixing.query),
    "op8_score_toxicity": _toxicity,
    "op9_dedup_phrases": _on_documents(phrase_dedup.query),
    "op10_shard": _on_documents(sharding.query),
    "op11_write_wavelet": _on_documents(wavelet.query),
    "op12_mine_phrases": _on_documents(phrase_mining.query),
    "op13_code_boxes": _codes,
}

ORACLE: dict[str, str] = {
    "op3_dedup_suffixes": suffix_dedup.SQL,
    "op6_join_jaccard": chosen_path.SQL,
    "op9_dedup_phrases": phrase_dedup.SQL,
    "op4_search_hamming": hamming_search.SQL,
    "op7_mix_sources": mixing.SQL,
    "op12_mine_phrases": phrase_mining.SQL,
    "op13_code_boxes": box_codes.SQL,
}
