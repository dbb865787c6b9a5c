"""Evaluation: confusion counts, per-class report, averages, confidence.

Metrics are computed from the confusion counts ``(true, pred, n)`` -- one
partial aggregation over the scored rows -- so the work after the scan is
proportional to k^2 classes, never to the rows. Precision/recall/F1 follow
the usual definitions with 0 where a denominator is 0; the class set is the
union of true and predicted labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cometa.session import materialize

REVIEW_THRESHOLD = 0.6
LEAST_PROBABILITY = 1e-300  # keeps logarithms finite


def confusion_counts(df: DataFrame, true_col: str, pred_col: str) -> DataFrame:
    """(true, pred, n) over rows where both are set.

    The null-prediction group is removed after aggregating (``count(pred)``),
    so a computed prediction is not re-evaluated in a pushed-down filter.
    """
    p = F.col(pred_col)
    return (
        df.where(F.col(true_col).isNotNull())
        .groupBy(F.col(true_col).alias("true_label"), p.alias("pred_label"))
        .agg(F.count(p).alias("n"))
        .where(F.col("n") > 0)
    )


def _safe_div(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def per_class_report(conf: DataFrame) -> DataFrame:
    """Label, precision, recall, f1, support (k rows)."""
    by_true = conf.groupBy(F.col("true_label").alias("label")).agg(
        F.sum("n").alias("support"),
        F.sum(F.when(F.col("true_label") == F.col("pred_label"), F.col("n")).otherwise(0)).alias("tp"),
    )
    by_pred = conf.groupBy(F.col("pred_label").alias("label")).agg(F.sum("n").alias("predicted"))
    j = by_true.join(by_pred, "label", "full_outer").na.fill(0, ["support", "tp", "predicted"])
    precision = _safe_div(F.col("tp").cast("double"), F.col("predicted").cast("double"))
    recall = _safe_div(F.col("tp").cast("double"), F.col("support").cast("double"))
    out = j.select("label", precision.alias("precision"), recall.alias("recall"), F.col("support").cast("bigint").alias("support"), "tp")
    f1 = _safe_div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return out.select("label", "precision", "recall", f1.alias("f1"), "support", "tp")


def report_averages(report: DataFrame) -> DataFrame:
    """Accuracy, macro and support-weighted precision/recall/F1."""
    n = F.sum("support")
    return report.agg(
        (F.sum("tp") / n).alias("accuracy"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("precision") * F.col("support")) / n).alias("weighted_precision"),
        (F.sum(F.col("recall") * F.col("support")) / n).alias("weighted_recall"),
        (F.sum(F.col("f1") * F.col("support")) / n).alias("weighted_f1"),
        n.cast("bigint").alias("n"),
    )


def with_softmax(df: DataFrame, scores_col: str, out_col: str) -> DataFrame:
    """Numerically stable softmax of an array column into ``out_col``.

    Staged over projections: Spark does not share subexpressions inside
    lambda functions, so an array expression referenced inside a lambda is
    re-evaluated per element. Materializing the input and the exponentials
    as columns keeps the cost linear in the array length.
    """
    e, s = "__sm_e", "__sm_s"
    out = df.withColumn(e, F.transform(scores_col, lambda x: F.exp(x - F.array_max(F.col(scores_col)))))
    out = out.withColumn(s, F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x))
    return out.withColumn(out_col, F.transform(e, lambda x: x / F.col(s))).drop(e, s)


def argmax(p: Column) -> Column:
    """O3: index of the largest probability; the first one wins ties."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def with_confidence(
    df: DataFrame, prob_col: str, threshold: float = REVIEW_THRESHOLD, prefix: str = ""
) -> DataFrame:
    """M7: predicted index, confidence (max probability) and the review flag
    (strictly below the threshold)."""
    p = F.col(prob_col)
    return df.withColumns(
        {
            f"{prefix}pred_idx": argmax(p),
            f"{prefix}confidence": F.array_max(p).cast("double"),
        }
    ).withColumn(f"{prefix}review", F.col(f"{prefix}confidence") < F.lit(threshold))


def with_temperature(df: DataFrame, prob_col: str, temperature: float, out_col: str) -> DataFrame:
    """Probabilities sharpened or flattened: ``p ** (1 / temperature)``, summing to 1 again; their order stays."""
    z, t = "__tm_z", F.lit(float(temperature))
    staged = df.withColumn(z, F.transform(prob_col, lambda x: F.log(F.greatest(x, F.lit(LEAST_PROBABILITY))) / t))
    return with_softmax(staged, z, out_col).drop(z)


def fit_temperature(df: DataFrame, prob_col: str, label_idx: str, steps: int = 8) -> float:
    """The temperature of least log loss on held-out rows, by Newton steps on its inverse.

    The loss is convex in the inverse, and a step needs two sums over the rows: of
    ``z_y - E[z]`` and of ``Var[z]``, with ``z`` the log probabilities under the
    present temperature. The inverse stays within [0.05, 20]. No rows: 1.
    """
    z = df.select(F.transform(prob_col, lambda x: F.log(F.greatest(x, F.lit(LEAST_PROBABILITY)))).alias("z"), F.col(label_idx).cast("int").alias("y"))
    z = materialize(z.withColumn("own", F.get("z", F.col("y"))), "held_out_scores")
    inverse = 1.0
    for _ in range(steps):
        p = with_softmax(z.withColumn("s", F.transform("z", lambda x: x * F.lit(inverse))), "s", "p")
        both = F.zip_with("p", "z", lambda a, b: F.struct((a * b).alias("one"), (a * b * b).alias("two")))
        moments = F.aggregate(both, F.struct(F.lit(0.0).alias("one"), F.lit(0.0).alias("two")), lambda a, x: F.struct((a["one"] + x["one"]).alias("one"), (a["two"] + x["two"]).alias("two")))
        m = p.withColumn("m", moments)
        got = m.agg(F.avg(F.col("own") - F.col("m.one")).alias("slope"), F.avg(F.col("m.two") - F.col("m.one") * F.col("m.one")).alias("curve")).first()
        if not got.curve or got.curve <= 1e-12:
            break
        inverse = min(20.0, max(0.05, inverse + got.slope / got.curve))
    return 1.0 / inverse


def calibration(df: DataFrame, prob_col: str, label_idx: str, bins: int = 10, threshold: float = REVIEW_THRESHOLD) -> DataFrame:
    """(log_loss, calibration_error, n_review, n): mean log loss; the mean distance of confidence and
    accuracy over equal-width bins of confidence, by their rows; rows below the threshold."""
    p, y = F.col(prob_col), F.col(label_idx).cast("int")
    rows = with_confidence(df, prob_col, threshold).select(
        (-F.log(F.greatest(F.get(p, y), F.lit(LEAST_PROBABILITY)))).alias("loss"),
        "confidence",
        "review",
        (F.col("pred_idx") == y).cast("double").alias("hit"),
    )
    bin_of = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1))
    per = rows.groupBy(bin_of.alias("bin")).agg(
        F.sum("loss").alias("loss"), F.sum("confidence").alias("said"), F.sum("hit").alias("hit"), F.count_if("review").alias("review"), F.count(F.lit(1)).alias("n")
    )
    n = F.sum("n")
    return per.agg((F.sum("loss") / n).alias("log_loss"), (F.sum(F.abs(F.col("said") - F.col("hit"))) / n).alias("calibration_error"), F.sum("review").alias("n_review"), n.alias("n"))


def review_count(df: DataFrame, flag_col: str = "review") -> DataFrame:
    """Rows flagged for manual review, and all rows."""
    return df.agg(F.count_if(F.col(flag_col)).alias("n_review"), F.count(F.lit(1)).alias("n_total"))
