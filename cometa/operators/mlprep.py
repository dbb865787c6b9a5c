"""Data preparation for learned labelling, as DataFrame operations.

Label encoders (E1/E2/J3/J4), one-hot (E3), rare-class filter (A9), balanced
class weights (A10), exact stratified split (M6), drop-na projections (P7),
fill sentinels (P8), labelled/pending split (P9), stage-2 context text (P11),
text vectorization vocabulary and fixed-length id sequences (E5/P12).

Scale notes: every per-class statistic is a ``groupBy`` with map-side partial
aggregation and is joined back through :func:`cometa.plans.joins.lookup_join`
(written once; Spark broadcasts it below its own threshold). Nothing is windowed
over a whole class: a class may hold a third of all rows. Fitting an encoder or
a lookup runs a job; the rest is lazy.
"""

from __future__ import annotations

from pyspark.ml.feature import OneHotEncoder, StringIndexer, StringIndexerModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cometa.plans.joins import lookup_join
from cometa.session import materialize

UNK = "__UNK__"

# ---------------------------------------------------------------------------
# Text vectorization defaults.
# ---------------------------------------------------------------------------
VOCAB_MAX_TOKENS = 5000  # includes the padding id 0 and the OOV id 1
SEQUENCE_LENGTH = 50
PAD_ID = 0
OOV_ID = 1
# ASCII punctuation removed by the default standardization.
PUNCT_RE = r"[!\"#$%&()\*\+,\-\./:;<=>?@\[\\\]^_`{|}~']"
ASCII_WS_RE = r"[ \t\n\x0B\f\r]+"
STAGE2_PREFIX = "Classificação aplicada: "
STAGE2_SEPARATOR = " | Comentário: "
# ---------------------------------------------------------------------------


# -- P7 / P8 / P9 / P11 -------------------------------------------------------


def drop_incomplete(df: DataFrame, subset: list[str]) -> DataFrame:
    """Drop rows with a null in any of ``subset`` (other nulls kept)."""
    return df.na.drop(how="any", subset=subset)


def fill_sentinel(df: DataFrame, cols: list[str], value=-1) -> DataFrame:
    """Fill nulls of feature columns with a sentinel."""
    return df.na.fill(value, subset=cols)


def split_labelled(df: DataFrame, label_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a label -> train, rows without -> predict)."""
    return df.where(F.col(label_col).isNotNull()), df.where(F.col(label_col).isNull())


def as_text(c: Column) -> Column:
    """Text cast the way the training scripts did: null becomes ``'nan'``."""
    return F.coalesce(c.cast("string"), F.lit("nan"))


def stage2_text(class_col: Column, text_col: Column) -> Column:
    """Context text for the consistency stage; null if either is null."""
    return F.concat(F.lit(STAGE2_PREFIX), class_col, F.lit(STAGE2_SEPARATOR), text_col)


# -- A8 / A9 / A10 --------------------------------------------------------------


def class_support(df: DataFrame, label_col: str) -> DataFrame:
    """Rows per class (labelled rows only)."""
    lbl = F.col(label_col)
    return df.groupBy(lbl.alias(label_col)).agg(F.count(lbl).alias("n")).where(F.col("n") > 0)


def rare_classes(df: DataFrame, label_col: str, min_count: int = 2) -> DataFrame:
    """A9 report: classes with fewer than ``min_count`` labelled rows."""
    return class_support(df, label_col).where(F.col("n") < min_count)


def drop_rare_classes(df: DataFrame, label_col: str, min_count: int = 2) -> DataFrame:
    """Keep labelled rows whose class has at least ``min_count`` rows.

    Counts come from a partial aggregation; the (small) class table is joined
    back by broadcast, so a hot class never lands in one task.
    """
    keep = class_support(df, label_col).where(F.col("n") >= min_count).select(label_col)
    return lookup_join(df.where(F.col(label_col).isNotNull()), keep, label_col, how="left_semi")


def balanced_class_weights(df: DataFrame, label_col: str, min_count: int = 1) -> DataFrame:
    """A10: ``n / (k * n_c)`` per class over the labelled rows of classes with
    at least ``min_count`` rows; one aggregation of the rows."""
    support = class_support(df, label_col).where(F.col("n") >= min_count)
    w = Window.partitionBy()  # over the class table only (k rows)
    return support.select(
        label_col,
        "n",
        (F.sum("n").over(w) / (F.count(F.lit(1)).over(w) * F.col("n"))).alias("weight"),
    )


def with_class_weight(df: DataFrame, label_col: str, weight_col: str = "weight") -> DataFrame:
    """Attach the balanced weight of each row's class (for ``weightCol``)."""
    weights = balanced_class_weights(df, label_col).select(label_col, F.col("weight").alias(weight_col))
    return lookup_join(df, weights, label_col, how="inner")


# -- E1 / E2 / E3 / J3 / J4 -----------------------------------------------------


def fit_label_encoder(df: DataFrame, col: str, output_col: str | None = None) -> StringIndexerModel:
    """Sorted classes -> 0..k-1 (unknown values raise, like a plain encoder)."""
    return StringIndexer(
        inputCol=col, outputCol=output_col or f"{col}_idx", stringOrderType="alphabetAsc", handleInvalid="error"
    ).fit(df.where(F.col(col).isNotNull()))


def class_table(df: DataFrame, col: str, extra: list[str] | None = None) -> DataFrame:
    """Sorted class list as ``(value, idx)``; ``extra`` values are added
    before sorting (e.g. the unknown token).

    The distinct values (partial aggregation, so a hot class costs one row
    per task) are range-sorted and written; a value's number is its place in
    its range plus the sizes of the ranges before (one row per range). Any
    number of classes works, and nothing is collected.
    """
    values = df.where(F.col(col).isNotNull()).select(F.col(col).cast("string").alias("value"))
    if extra:
        values = values.unionByName(df.sparkSession.createDataFrame([(x,) for x in extra], "value string"))
    place = F.monotonically_increasing_id()
    ranged = materialize(values.distinct().orderBy("value").withColumn("__at", place), "classes")
    ranged = ranged.select("value", F.shiftright("__at", 33).alias("__range"), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)).alias("__at"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    starts = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    numbered = ranged.join(starts, "__range").select("value", (F.col("__start") + F.col("__at")).cast("int").alias("idx"))
    return materialize(numbered, "class_table")


def encode_labels(df: DataFrame, col: str, classes: DataFrame, out_col: str | None = None) -> DataFrame:
    """Map values to their class index; null stays null, and a value that
    ``classes`` lacks ends the job."""
    out_col = out_col or f"{col}_idx"
    lookup = classes.select(F.col("value").alias("__v"), F.col("idx").alias("__idx"))
    joined = df.withColumn("__v", F.col(col).cast("string")).join(lookup, "__v", "left")
    unseen = F.raise_error(F.concat(F.lit("unseen label: "), F.col("__v"))).cast("int")
    idx = F.when(F.col("__idx").isNull() & F.col("__v").isNotNull(), unseen).otherwise(F.col("__idx"))
    return joined.withColumn(out_col, idx).drop("__v", "__idx")


def encode_with_unknown(df: DataFrame, col: str, classes: DataFrame, out_col: str | None = None) -> DataFrame:
    """Map values to their class index; unseen values (and nulls) to
    the index of the unknown token, which must be in ``classes``."""
    out_col = out_col or f"{col}_idx"
    unk = classes.where(F.col("value") == UNK).select("idx").first()
    if unk is None:
        raise ValueError(f"class table has no {UNK} entry")
    lookup = classes.select(F.col("value").alias("__v"), F.col("idx").alias("__idx"))
    joined = lookup_join(df.withColumn("__v", F.col(col).cast("string")), lookup, "__v", how="left")
    return joined.withColumn(out_col, F.coalesce(F.col("__idx"), F.lit(unk[0]))).drop("__v", "__idx")


def decode_labels(df: DataFrame, idx_col: str, classes: DataFrame, out_col: str) -> DataFrame:
    """Class index -> class name (inverse transform)."""
    lookup = classes.select(F.col("idx").alias("__i"), F.col("value").alias(out_col))
    return lookup_join(df.withColumn("__i", F.col(idx_col).cast("int")), lookup, "__i", how="left").drop("__i")


def one_hot(idx: Column, size: int) -> Column:
    """One-hot array of a class index over ``size`` classes (all kept).

    Inside ML pipelines use ``OneHotEncoder(dropLast=False)`` for vectors.
    """
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(i == idx, 1).otherwise(0))


def one_hot_encoder(idx_col: str, out_col: str) -> OneHotEncoder:
    return OneHotEncoder(inputCols=[idx_col], outputCols=[out_col], dropLast=False, handleInvalid="keep")


# -- M6 -------------------------------------------------------------------------


def stratified_split(
    df: DataFrame,
    label_col: str,
    key_col: str,
    train_share: float = 0.8,
    seed: int = 42,
    buckets: int = 4096,
    written: bool = False,
) -> DataFrame:
    """M6: exact per-class split; adds ``split`` = 'train' | 'val'.

    Each row gets a seeded hash ``u``; within a class the first
    ``round(train_share * n_c)`` rows by ``(u, key)`` go to train. Counts per
    (class, hash bucket) name the one bucket of each class that holds the
    quota's last row; only that bucket is ranked, as narrow ``(class, u, key)``
    rows, and gives the class a last ``(u, key)`` of train. Every row compares
    itself with that pair, so no text goes through a window and no class needs
    one task. Rows that repeat a key stay on one side; keys should be unique
    for exact counts. Lazy: nothing runs here, unless ``written``: the pairs are
    then written first, so that Spark knows their size and does not deal the
    rows by class to join them.
    """
    lbl = F.col(label_col)
    key = F.col(key_col).cast("string")
    u = F.xxhash64(key, F.lit(seed)).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))
    base = df.where(lbl.isNotNull()).withColumns({"__u": u, "__k": F.coalesce(key, F.lit(""))})
    bucket = F.floor(F.col("__u").cast("double") / F.lit(2.0**63) * buckets).cast("int")
    narrow = base.select(lbl.alias("__c"), "__u", "__k", bucket.alias("__b"))
    per_bucket = narrow.groupBy("__c", "__b").agg(F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy("__c")
    upto = F.sum("__n").over(whole.orderBy("__b"))
    quota = F.round(F.sum("__n").over(whole) * F.lit(train_share)).cast("long")
    edge = per_bucket.select("__c", "__b", "__n", upto.alias("__upto"), quota.alias("__quota"))
    edge = edge.where((F.col("__quota") > F.col("__upto") - F.col("__n")) & (F.col("__quota") <= F.col("__upto")))
    edge = edge.select("__c", "__b", (F.col("__quota") - F.col("__upto") + F.col("__n")).alias("__place"))
    ranked = narrow.join(edge, ["__c", "__b"]).withColumn("__r", F.row_number().over(whole.orderBy("__u", "__k")))
    last = ranked.where(F.col("__r") == F.col("__place")).select(F.col("__c").alias(label_col), F.struct("__u", "__k").alias("__last"))
    # a class whose quota is 0 has no last row of train
    own = F.struct("__u", "__k")
    split = F.when(F.col("__last").isNotNull() & (own <= F.col("__last")), "train").otherwise("val")
    joined = lookup_join(base, last, label_col) if written else base.join(last, label_col, "left")
    return joined.withColumn("split", split).select(*df.columns, "split")


# -- E5 / P12 ---------------------------------------------------------------------


def standardize_text(c: Column) -> Column:
    """Lower-case ASCII letters and drop ASCII punctuation (the vectorizer's
    default standardization; non-ASCII letters are left as they are)."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.regexp_replace(F.translate(c, upper, upper.lower()), PUNCT_RE, "")


def tokenize(c: Column) -> Column:
    """Whole-text tokens: standardized, split on ASCII whitespace, no empties."""
    return F.filter(F.split(standardize_text(c), ASCII_WS_RE), lambda t: t != "")


def fit_vocabulary(df: DataFrame, text_col: str, max_tokens: int = VOCAB_MAX_TOKENS) -> DataFrame:
    """E5: the ``max_tokens - 2`` most frequent tokens as ``(token, n, id)``;
    ids start at 2 (0 = padding, 1 = out of vocabulary); ties by token.

    Token counts are partially aggregated per task; the top-k is a bounded
    ``TakeOrderedAndProject``.
    """
    k = max_tokens - 2
    counts = (
        df.select(F.explode(tokenize(F.col(text_col))).alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    top = counts.orderBy(F.desc("n"), F.asc("token")).limit(k)
    return top.select("token", "n", (F.row_number().over(Window.orderBy(F.desc("n"), F.asc("token"))) + 1).alias("id"))


def token_ids(
    df: DataFrame, key_col: str, text_col: str, vocab: DataFrame, length: int = SEQUENCE_LENGTH
) -> DataFrame:
    """``(key, n_tokens, ids)`` -- the whole text is tokenized
    (``n_tokens``); ``ids`` is the fixed-length sequence: the first
    ``length`` token ids, out-of-vocabulary = 1, padded with 0.

    The vocabulary is bounded by ``max_tokens`` and broadcast; the regroup
    per key holds at most ``length`` rows.
    """
    toks = df.select(F.col(key_col).alias("__k"), tokenize(F.col(text_col)).alias("__t"))
    head = toks.select("__k", F.size("__t").alias("n_tokens"), F.posexplode_outer(F.slice("__t", 1, length)).alias("__p", "token"))
    ids = lookup_join(head, vocab.select("token", F.col("id").alias("__id")), "token", how="left")
    grouped = ids.groupBy("__k", "n_tokens").agg(
        F.array_sort(F.collect_list(F.when(F.col("token").isNotNull(), F.struct("__p", F.coalesce("__id", F.lit(OOV_ID)).alias("id"))))).alias("__s")
    )
    seq = F.transform(F.col("__s"), lambda s: s["id"].cast("int"))
    padded = F.concat(seq, F.array_repeat(F.lit(PAD_ID), F.greatest(F.lit(0), F.lit(length) - F.size(seq))))
    return grouped.select(F.col("__k").alias(key_col), F.col("n_tokens").cast("bigint").alias("n_tokens"), padded.alias("ids"))
