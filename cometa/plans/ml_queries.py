"""Registered ML-preparation and evaluation queries (SQL-checkable)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cometa.operators import category_stats as cs
from cometa.operators import evalmetrics as em
from cometa.operators import mlprep as mp
from cometa.operators import word_vectors as wv
from cometa.operators.embed_cache import cache_misses
from cometa.plans.audit_queries import aud
from cometa.plans.joins import lookup_join
from cometa.plans.partitioning import spread_for_cpu
from cometa.operators.validate import with_audit_label
from cometa.session import materialize
from cometa.sources.derived import labelled_documents
from cometa.sources.tables import table


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their (partly null) label. Whole-text tokenization is
    CPU-heavy per row, so a scan with fewer splits than cores is spread
    first (a no-op on a large table)."""
    return labelled_documents(spread_for_cpu(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def labelled(spark, sf_dir) -> DataFrame:
    return mp.split_labelled(docs(spark, sf_dir), "label")[0]


def pending_split(spark, sf_dir):
    """Labelled rows train, the rest are predicted."""
    d = docs(spark, sf_dir)
    return d.select("doc_id", F.when(F.col("label").isNotNull(), "train").otherwise("predict").alias("split"))


def class_support(spark, sf_dir):
    return mp.class_support(docs(spark, sf_dir), "label")


def rare_class_filter(spark, sf_dir):
    return mp.drop_rare_classes(docs(spark, sf_dir), "label", min_count=2).select("doc_id", "label")


def class_weights(spark, sf_dir):
    w = mp.balanced_class_weights(docs(spark, sf_dir), "label", min_count=2)
    return w.select("label", "n", F.round("weight", 6).alias("weight"))


def label_encode(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mp.encode_labels(d, "source", mp.class_table(d, "source"), "source_idx")


def encode_unk(spark, sf_dir):
    """Classes fitted on the labelled rows plus the unknown token; all
    documents encoded (sources never labelled map to the unknown index)."""
    classes = mp.class_table(labelled(spark, sf_dir), "source", extra=[mp.UNK])
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mp.encode_with_unknown(d, "source", classes, "source_idx").select(
        "doc_id", "source", F.col("source_idx").cast("int").alias("source_idx")
    )


def one_hot(spark, sf_dir):
    lab = labelled(spark, sf_dir).select("doc_id", "label")
    classes = mp.class_table(lab, "label")
    k = int(classes.count())
    lookup = classes.select(F.col("value").alias("label"), F.col("idx").alias("label_idx"))
    out = lookup_join(lab, lookup, "label", how="inner")
    return out.select("doc_id", "label", mp.one_hot(F.col("label_idx"), k).alias("one_hot"))


def stratified_split_counts(spark, sf_dir):
    s = mp.stratified_split(labelled(spark, sf_dir), "label", "doc_id", train_share=0.8, seed=42)
    return s.groupBy("label", "split").agg(F.count(F.lit(1)).alias("n"))


def stage2_text(spark, sf_dir):
    d = docs(spark, sf_dir)
    return d.select("doc_id", mp.stage2_text(F.col("label"), F.col("text")).alias("stage2_text"))


def labelled_dropna(spark, sf_dir):
    """P7 (stage-2 flavour): drop rows without text or class; keep null sigla."""
    d = docs(spark, sf_dir).select(
        "doc_id", "text", F.col("label").alias("classificacao"), F.when(F.col("toxic") == 1, "TOX").alias("sigla")
    )
    return mp.drop_incomplete(d, ["text", "classificacao"])


def vocab_topk(spark, sf_dir):
    return mp.fit_vocabulary(labelled(spark, sf_dir), "text")


def token_sequence(spark, sf_dir):
    lab = labelled(spark, sf_dir)
    vocab = mp.fit_vocabulary(lab, "text")
    return mp.token_ids(lab, "doc_id", "text", vocab)


def embedding_cache_misses(spark, sf_dir):
    """Distinct texts of all documents not yet in a cache that holds the
    texts of the labelled documents."""
    all_docs = table(spark, sf_dir, "documents").select("text")
    cached = labelled(spark, sf_dir).select(F.sha2(F.col("text"), 256).alias("text_key"))
    return cache_misses(all_docs, "text", cached)


def cooccurrence_ppmi(spark, sf_dir):
    """Positive PMI of the 300 most frequent tokens, at most 2 apart, over all documents."""
    d = spread_for_cpu(table(spark, sf_dir, "documents"))
    vocab = materialize(mp.fit_vocabulary(d, "text", 302), "ppmi_vocabulary")
    weights = wv.positive_pmi(wv.cooccurrences(d, "text", vocab, 2))
    names = vocab.select("token", "id")
    for end, out in (("a", "token"), ("b", "other")):
        weights = lookup_join(weights, names.withColumnsRenamed({"token": out, "id": end}), end, how="inner")
    return weights.select("token", "other", "n", F.round("weight", 6).alias("ppmi"))


def word_factors(spark, sf_dir):
    """Products of the factors of the weight matrix (300 tokens, 16 factors) with each other: they are orthonormal."""
    v = wv.learn_word_vectors(spread_for_cpu(table(spark, sf_dir, "documents")), "text", 302, 2, 16)
    x = v.select("id", F.posexplode("factors").alias("i", "x"))
    pairs = x.join(x.select("id", F.col("i").alias("j"), F.col("x").alias("y")), "id")
    return pairs.groupBy("i", "j").agg((F.round(F.sum(F.col("x") * F.col("y")), 6) + F.lit(0.0)).alias("product"))


def word_neighbours(spark, sf_dir):
    """The nearest of the 1,000 most frequent tokens to the ten most frequent."""
    d = spread_for_cpu(table(spark, sf_dir, "documents"))
    v = materialize(wv.learn_word_vectors(d, "text", 1002), "word_vectors")
    words = [r.token for r in v.where("id < 10").collect()]
    return wv.nearest_words(v, words)


def _scored_audit(spark, sf_dir):
    """Prior labels as truth, the rule label as prediction."""
    return with_audit_label(aud(spark, sf_dir), "nota", "comentario", "pred")


def category_statistics(spark, sf_dir):
    """For each record and class, the class's smoothed share among the other
    records of the same comment (outside the record's fold)."""
    a = cs.with_fold(aud(spark, sf_dir), "analise_previa", F.col("k"))
    stats = cs.fit_statistics(a, ["comentario"], "analise_previa")
    rows = stats.shares(a, "fold", "shares").select("k", "fold", F.posexplode("shares").alias("at", "share"))
    classes = F.array(*[F.lit(c) for c in stats.classes])
    return rows.select("k", "fold", F.element_at(classes, F.col("at") + 1).alias("label"), F.round("share", 9).alias("share"))


def report_by_class(spark, sf_dir):
    conf = em.confusion_counts(_scored_audit(spark, sf_dir), "analise_previa", "pred")
    r = em.per_class_report(conf)
    return r.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


def report_averages(spark, sf_dir):
    conf = em.confusion_counts(_scored_audit(spark, sf_dir), "analise_previa", "pred")
    avg = em.report_averages(em.per_class_report(conf))
    return avg.select(*[F.round(c, 6).alias(c) for c in avg.columns if c != "n"], "n")


# Class-probability rows for O3/M7 are derived from the whole embedding:
# component i adds to the score of class i mod N_SCORE_CLASSES, and the sums
# are divided by SCORE_TEMPERATURE before the softmax (so that both sides of
# the review threshold occur).
N_SCORE_CLASSES = 10
SCORE_TEMPERATURE = 0.1


def _class_scores(emb):
    x = F.transform(emb, lambda v: v.cast("double"))
    return F.transform(
        F.sequence(F.lit(0), F.lit(N_SCORE_CLASSES - 1)),
        lambda j: F.aggregate(F.filter(x, lambda v, i: i % N_SCORE_CLASSES == j), F.lit(0.0), lambda a, v: a + v)
        / F.lit(SCORE_TEMPERATURE),
    )


def _probs(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", _class_scores(F.col("embedding")).alias("__x"))
    return em.with_softmax(e, "__x", "p").drop("__x")


def argmax_confidence(spark, sf_dir):
    s = em.with_confidence(_probs(spark, sf_dir), "p")
    return s.select("vec_id", "pred_idx", F.round("confidence", 6).alias("confidence"), "review")


def review_queue(spark, sf_dir):
    return em.review_count(em.with_confidence(_probs(spark, sf_dir), "p"))


QUERIES = {
    "pending_split": pending_split,
    "class_support": class_support,
    "rare_class_filter": rare_class_filter,
    "class_weights": class_weights,
    "category_statistics": category_statistics,
    "label_encode": label_encode,
    "encode_unk": encode_unk,
    "one_hot": one_hot,
    "stratified_split_counts": stratified_split_counts,
    "stage2_text": stage2_text,
    "labelled_dropna": labelled_dropna,
    "vocab_topk": vocab_topk,
    "token_sequence": token_sequence,
    "embedding_cache_misses": embedding_cache_misses,
    "cooccurrence_ppmi": cooccurrence_ppmi,
    "word_factors": word_factors,
    "word_neighbours": word_neighbours,
    "report_by_class": report_by_class,
    "report_averages": report_averages,
    "argmax_confidence": argmax_confidence,
    "review_queue": review_queue,
}
