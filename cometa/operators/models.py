"""Learned labelling with MLlib: the same contracts as the original models,
re-aimed at distributed estimators.

* M1/M2  random forest over the note and out-of-fold class shares of note, comment and their pair
* M3     note one-hot + token uni/bi/tri-gram TF-IDF, unit length -> weighted logistic regression
* M4     note one-hot + cached text embedding -> weighted logistic regression
* M5/M10 two-stage: text -> class; (class, text) -> consistency code; review
          when either confidence is below the threshold
* M7     arg-max label, confidence, review flag; J3 decode
* M8     saved-model reuse by content and class-table contents; M9 loss history by epoch

Encodings that could grow with the data never pass through the driver: the
comment code is a 64-bit hash in two numbers (not a collected dictionary), the key of
the comment's class shares, and text features are hashed (as ``HashingTF`` does). The label and note indexers of a fitted
model live on the driver, as the model's own coefficients do: a row of them per
class and per note.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import (
    IDF,
    Normalizer,
    SQLTransformer,
    StringIndexer,
    StringIndexerModel,
    VectorAssembler,
    VectorSizeHint,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cometa.functions.grams import hashed_counts
from cometa.operators import category_stats as cs
from cometa.operators import epochs as ep
from cometa.operators import evalmetrics as em
from cometa.operators import mlprep as mp
from cometa.plans.joins import lookup_join
from cometa.session import materialize, shared_path

TEXT_FEATURES = 1 << 14
COMMENT_CODES = ["comment_high", "comment_low"]
FOLD = "__fold"
TREES_AT_ONCE = 8  # trees fitted side by side
CELLS_A_TASK = 50_000  # distinct rows of features and label that a tree's task reads; fewer make no more tasks


def _weighted(train: DataFrame, label_col: str) -> DataFrame:
    return mp.with_class_weight(train, label_col, "weight")


def _label_indexer(label_col: str) -> StringIndexer:
    return StringIndexer(inputCol=label_col, outputCol="label_idx", stringOrderType="alphabetAsc", handleInvalid="error")


def _category_indexer(col: str) -> StringIndexer:
    # the index after the last is the unknown category's
    return StringIndexer(inputCol=col, outputCol=f"{col}_idx", stringOrderType="alphabetAsc", handleInvalid="keep")


def _category_stage(train: DataFrame, col: str, also: DataFrame | None):
    """The category indexer: fitted on the training rows and, if given, on the
    target rows too, so a category of the target has an index of its own."""
    if also is None:
        return _category_indexer(col)
    return _category_indexer(col).fit(train.select(col).unionByName(also.select(col)).where(F.col(col).isNotNull()))


def decode_prediction(
    pred: DataFrame, model: PipelineModel, out_col: str, prefix: str = "", total_col: str | None = None, temperature: float = 1.0
) -> DataFrame:
    """M7 + J3: class name of the arg-max, confidence and review flag, of the
    probabilities at ``temperature``; ``total_col`` adds their sum."""
    labels = [s for s in model.stages if isinstance(s, StringIndexerModel) and s.getOutputCol() == "label_idx"][0].labels
    p = vector_to_array(F.col("probability"))
    out = pred.withColumn("__p", p)
    if temperature != 1.0:
        out = em.with_temperature(out, "__p", temperature, "__p")
    out = em.with_confidence(out, "__p", prefix=prefix)
    if total_col:
        out = out.withColumn(total_col, F.aggregate("__p", F.lit(0.0), lambda a, x: a + x))
    names = F.array(*[F.lit(x) for x in labels])
    return out.withColumn(out_col, F.element_at(names, F.col(f"{prefix}pred_idx") + 1)).drop(
        "__p", "probability", "rawPrediction", "prediction", "label_idx"
    )


# -- M1 / M2 --------------------------------------------------------------------


def with_comment_code(df: DataFrame, comment_col: str) -> DataFrame:
    """The comment's category code as the halves of its 64-bit hash, each
    exact in a double, so unlike comments have unlike codes; null is -1."""
    h = F.xxhash64(F.col(comment_col))
    code = {COMMENT_CODES[0]: F.shiftright(h, 32), COMMENT_CODES[1]: h.bitwiseAND(F.lit(0xFFFFFFFF))}
    known = F.col(comment_col).isNotNull()
    return df.withColumns({c: F.when(known, x.cast("double")).otherwise(-1.0) for c, x in code.items()})


@dataclass
class ForestModel:
    """M1/M2: the trees and the category statistics that make their features."""

    stages: PipelineModel
    trees: list[RandomForestClassificationModel]
    statistics: dict[str, cs.CategoryStatistics]
    nota_col: str
    comment_col: str

    def transform(self, df: DataFrame, then: Callable[[DataFrame], DataFrame] = lambda votes: votes) -> DataFrame:
        """Rows to predict with the forest's ``probability``, the mean of its trees', or with what
        ``then`` makes of it. The trees see every distinct row of features once."""
        by_row = {name: s for name, s in self.statistics.items() if name != "note_shares"}  # a note's shares follow from the note
        cols = [c for c in df.columns if c != FOLD]
        rows = _category_shares(with_comment_code(df.withColumn(FOLD, F.lit(cs.ALL)), self.comment_col), by_row).select(*cols, *by_row)
        rows = materialize(rows, "forest_rows")
        alike = [self.nota_col, *by_row]
        votes = self.statistics["note_shares"].shares(rows.select(*alike).distinct().withColumn(FOLD, F.lit(cs.ALL)), FOLD, "note_shares")
        votes = self.stages.transform(_share_vectors(votes, self.statistics)).select(*alike, "features")
        for i, tree in enumerate(self.trees):
            votes = tree.setProbabilityCol(f"__tree{i}").transform(votes)
        each = F.array(*[vector_to_array(F.col(f"__tree{i}")) for i in range(len(self.trees))])
        none = F.array_repeat(F.lit(0.0), self.trees[0].numClasses)
        votes = votes.select(*alike, F.aggregate(each, none, lambda a, p: F.zip_with(a, p, lambda x, y: x + y)).alias("__sum"))
        # a tree whose sample had no row at all has no vote
        mean = F.transform("__sum", lambda x: x / F.greatest(F.lit(1.0), F.aggregate("__sum", F.lit(0.0), lambda a, y: a + y)))
        votes = then(votes.select(*alike, array_to_vector(mean).alias("probability")))
        votes = materialize(votes.select(*[F.col(c).alias(f"__{c}") for c in alike], *[c for c in votes.columns if c not in alike]), "forest_votes")
        same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in alike]
        return rows.join(votes, same, "left").drop(*by_row, *[f"__{c}" for c in alike])


def _category_shares(df: DataFrame, statistics: dict[str, cs.CategoryStatistics]) -> DataFrame:
    for name, s in statistics.items():
        df = s.shares(df, FOLD, name)
    return df


def _share_vectors(df: DataFrame, names) -> DataFrame:
    return df.withColumns({f"{n}_vec": array_to_vector(F.col(n)) for n in names})


def _bootstrap(trees: int, seed: int):
    """How often each tree's bootstrap sample has ``n`` equal rows: a Poisson number of mean ``n``,
    which is the sum of one of mean 1 for each; from the rows' hash, so that a rerun draws the same."""

    @F.pandas_udf("array<int>")
    def draw(key: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([np.random.default_rng([seed, k & (2**64 - 1)]).poisson(m, trees).astype("int32") for k, m in zip(key.tolist(), n.tolist())])

    return draw


def with_forest_fold(train: DataFrame, seed: int = 42) -> DataFrame:
    """Deal the training rows into folds by their place; to be written before it is used."""
    return train.withColumn(FOLD, F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)), F.lit(cs.FOLDS)).cast("int"))


def fit_forest(
    train: DataFrame,
    nota_col: str,
    comment_col: str,
    label_col: str,
    trees: int = 100,
    seed: int = 42,
    max_depth: int = 30,
    balanced: bool = False,
) -> ForestModel:
    """M1/M2 (and M2b with ``trees=200, max_depth=10, balanced=True``): random
    forest over the note index and, for the note, the comment and the pair of
    both, the share of each class among the category's other rows (out of fold,
    see ``category_stats``), so any number of comments can be told apart. The
    original sets no depth; 30 is the most that MLlib has. ``balanced`` weights
    every row by its class's balanced weight (A10). The note index is an
    ordinary number to the trees (its category metadata is dropped), and there
    are as many bins as notes, so neighbouring notes can be told apart too.

    Training rows with the same features and label are one row to a tree, taken
    as often as its bootstrap sample has them, and each tree is a forest of one
    over these distinct rows; so its passes grow with them and not with all rows.

    ``train`` has the fold of :func:`with_forest_fold`."""
    keys = {"note_shares": [nota_col], "comment_shares": COMMENT_CODES, "pair_shares": [nota_col, *COMMENT_CODES]}
    counted = with_comment_code(train, comment_col).groupBy(nota_col, *COMMENT_CODES, FOLD, label_col).agg(F.count(F.lit(1)).alias("__rows"))
    counted = materialize(counted, "forest_counts")
    statistics: dict[str, cs.CategoryStatistics] = {}
    classes = None
    for name, cols in list(keys.items())[:2]:
        statistics[name] = cs.fit_statistics(counted, cols, label_col, FOLD, classes, rows="__rows")
        classes = statistics[name].classes
    # counted already is what the pairs' statistics count
    pairs = counted.select(*keys["pair_shares"], F.col(FOLD).alias("__f"), F.col(label_col).alias("__c"), F.col("__rows").alias("__n"))
    statistics["pair_shares"] = cs.CategoryStatistics(pairs, keys["pair_shares"], classes)
    alike = [label_col, nota_col, *keys]
    cells = _category_shares(counted, statistics).groupBy(*alike).agg(F.sum("__rows").alias("__rows"))
    cells = cells.withColumn("__drawn", _bootstrap(trees, seed)(F.xxhash64(*alike), F.col("__rows")))
    cells = cells.select(*alike, *[F.col("__drawn")[i].alias(f"__drawn{i}") for i in range(trees)])
    cells = materialize(cells, "forest_cells")
    parts = 1 + cells.count() // CELLS_A_TASK
    weight = F.lit(1.0)
    if balanced:
        cells = lookup_join(cells, mp.balanced_class_weights(train, label_col).select(label_col, "weight"), label_col, how="inner")
        weight = F.col("weight")
    notes = _category_indexer(nota_col).fit(cells)
    stages = [
        notes,
        SQLTransformer(statement=f"SELECT *, `{nota_col}_idx` + 0.0D AS nota_code FROM __THIS__"),
        *[VectorSizeHint(inputCol=f"{k}_vec", size=len(classes), handleInvalid="optimistic") for k in keys],
        VectorAssembler(inputCols=["nota_code", *[f"{k}_vec" for k in keys]], outputCol="features"),
    ]
    vectors = _share_vectors(cells, keys)
    features = Pipeline(stages=stages).fit(vectors)
    labels = _label_indexer(label_col).fit(cells)
    prepared = labels.transform(features.transform(vectors)).coalesce(parts)

    def fit_tree(i: int) -> RandomForestClassificationModel:
        tree = RandomForestClassifier(
            featuresCol="features", labelCol="label_idx", weightCol="weight", predictionCol="", rawPredictionCol="",
            numTrees=1, bootstrap=False, featureSubsetStrategy="sqrt", seed=seed + i, maxDepth=max_depth, maxMemoryInMB=512, maxBins=max(32, len(notes.labels) + 1),
        )
        return tree.fit(prepared.select("label_idx", "features", (F.col(f"__drawn{i}") * weight).alias("weight")))

    with ThreadPool(TREES_AT_ONCE) as pool:
        fitted = pool.map(inheritable_thread_target(train.sparkSession)(fit_tree), range(trees))
    return ForestModel(PipelineModel([labels, *features.stages]), fitted, statistics, nota_col, comment_col)


def forest_fill(
    df: DataFrame,
    nota_col: str,
    comment_col: str,
    label_col: str,
    trees: int = 100,
    seed: int = 42,
    max_depth: int = 30,
    balanced: bool = False,
) -> DataFrame:
    """M1/M2 + U2: train on labelled rows, label the rest, return kept rows
    followed by filled rows with ``origin`` = kept | filled."""
    train, todo = mp.split_labelled(df, label_col)
    # written once: the statistics, the indexer fits and the kept rows of the
    # output read it instead of recomputing the input's lineage
    train = materialize(with_forest_fold(train, seed), "forest_train")
    model = fit_forest(train, nota_col, comment_col, label_col, trees, seed, max_depth, balanced)
    filled = model.transform(todo, lambda votes: decode_prediction(votes, model.stages, "__pred")).withColumn(label_col, F.col("__pred"))
    cols = df.columns
    return train.select(*cols, F.lit("kept").alias("origin")).unionByName(
        filled.select(*cols, F.lit("filled").alias("origin"))
    )


# -- M3 / M4 / M5 ---------------------------------------------------------------------


def text_feature_stages(text_col: str, prefix: str = "") -> list:
    """Token uni/bi/tri-grams, hashed term frequencies, IDF, unit length."""
    return [
        _GramStage(text_col, f"{prefix}tf"),
        IDF(inputCol=f"{prefix}tf", outputCol=f"{prefix}idf", minDocFreq=1),
        # unit length: a long text is no surer than a short one
        Normalizer(p=2.0, inputCol=f"{prefix}idf", outputCol=f"{prefix}tfidf"),
    ]


from pyspark.ml import Transformer  # noqa: E402
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable  # noqa: E402
from pyspark.ml.param.shared import Param, Params, TypeConverters  # noqa: E402


class _GramStage(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Pipeline stage: hashed counts of the 1- to 3-grams of whole-text tokens,
    counted from the text at once (see ``functions.grams``)."""

    inputCol = Param(Params._dummy(), "inputCol", "input", typeConverter=TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "output", typeConverter=TypeConverters.toString)
    numFeatures = Param(Params._dummy(), "numFeatures", "hash indexes", typeConverter=TypeConverters.toInt)

    def __init__(self, inputCol: str = "text", outputCol: str = "tf", numFeatures: int = TEXT_FEATURES):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol, numFeatures=numFeatures)

    def _transform(self, df):
        count = hashed_counts(3, self.getOrDefault(self.numFeatures))
        return df.withColumn(self.getOrDefault(self.outputCol), count(F.col(self.getOrDefault(self.inputCol))))


def _text_feature_model(
    train: DataFrame, text_col: str, label_col: str, nota_col: str | None, prefix: str, also: DataFrame | None
) -> PipelineModel:
    stages = [_label_indexer(label_col)] + text_feature_stages(text_col, prefix)
    inputs = [f"{prefix}tfidf"]
    if nota_col:
        stages += [_category_stage(train, nota_col, also), mp.one_hot_encoder(f"{nota_col}_idx", f"{nota_col}_vec")]
        inputs = [f"{nota_col}_vec"] + inputs
    stages += [VectorAssembler(inputCols=inputs, outputCol="features")]
    return Pipeline(stages=stages).fit(train)


def _regression(reg_param: float, max_iter: int) -> LogisticRegression:
    return LogisticRegression(
        featuresCol="features", labelCol="label_idx", weightCol="weight", regParam=reg_param, maxIter=max_iter, standardization=False
    )


def fit_text_classifier(
    train: DataFrame,
    text_col: str,
    label_col: str,
    nota_col: str | None = None,
    reg_param: float = 0.001,
    prefix: str = "",
    also: DataFrame | None = None,
) -> PipelineModel:
    """M3: (note one-hot +) text n-gram TF-IDF -> logistic regression with
    balanced class weights; ``also``: target rows whose notes get an index."""
    return select_by_macro_f1(train, None, text_col, label_col, (reg_param,), prefix, nota_col, also)


def fit_vector_classifier(
    train: DataFrame,
    vec_col: str,
    label_col: str,
    nota_col: str | None = None,
    reg_param: float = 0.01,
    max_iter: int = 50,
    also: DataFrame | None = None,
) -> PipelineModel:
    """M4: (note one-hot +) frozen embedding -> weighted logistic regression."""
    stages = [_label_indexer(label_col)]
    inputs = ["__vec"]
    if nota_col:
        stages += [_category_stage(train, nota_col, also), mp.one_hot_encoder(f"{nota_col}_idx", f"{nota_col}_vec")]
        inputs = [f"{nota_col}_vec"] + inputs
    stages += [VectorAssembler(inputCols=inputs, outputCol="features"), _regression(reg_param, max_iter)]
    prepared = _weighted(train, label_col).withColumn("__vec", array_to_vector(F.col(vec_col)))
    return Pipeline(stages=stages).fit(prepared)


def vectorize(df: DataFrame, vec_col: str) -> DataFrame:
    return df.withColumn("__vec", array_to_vector(F.col(vec_col)))


def evaluate(model: PipelineModel, val: DataFrame, label_col: str) -> tuple[DataFrame, DataFrame]:
    """A11/A12 on a validation split: (per-class report, averages)."""
    scored = decode_prediction(model.transform(val), model, "__pred")
    conf = materialize(em.confusion_counts(scored, label_col, "__pred"), "confusion")  # the report reads it more than once
    rep = em.per_class_report(conf)
    return rep, em.report_averages(rep)


def select_by_macro_f1(
    train: DataFrame,
    val: DataFrame | None,
    text_col: str,
    label_col: str,
    reg_params=(0.001, 0.01),
    prefix: str = "",
    nota_col: str | None = None,
    also: DataFrame | None = None,
    max_iter: int = 30,
) -> PipelineModel:
    """M5: keep the candidate with the best validation macro F1.

    Features are fitted once and written as narrow tables (label, weight,
    vector); only the classifier is refitted per candidate.
    """
    weighted = _weighted(train, label_col)
    feats = _text_feature_model(weighted, text_col, label_col, nota_col, prefix, also)
    tr = materialize(feats.transform(weighted).select("label_idx", "weight", "features"), "model_features")
    va = None
    if val is not None and len(reg_params) > 1:
        va = materialize(feats.transform(val).select(label_col, "label_idx", "features"), "model_validation")
    best, best_f1 = None, -1.0
    for reg in reg_params:
        clf = _regression(reg, max_iter).fit(tr)
        model = PipelineModel(stages=list(feats.stages) + [clf])
        if va is None:
            return model
        scored = decode_prediction(clf.transform(va), model, "__pred")
        rep = em.per_class_report(em.confusion_counts(scored, label_col, "__pred"))
        f1 = em.report_averages(rep).first()["macro_f1"] or 0.0
        if f1 > best_f1:
            best, best_f1 = model, f1
    return best


def fit_by_epochs(
    train: DataFrame,
    val: DataFrame,
    stages: list,
    inputs: list[str],
    label_col: str,
    folder: str,
    by: str = "loss",
    patience: int = ep.PATIENCE,
    max_epochs: int = ep.MAX_EPOCHS,
    penalty: float = ep.PENALTY,
) -> PipelineModel:
    """M3/M4/M5: features fitted on ``train``, then softmax regression by epochs,
    the best by the validation rows kept (see ``epochs``). Training rows have
    balanced class weights, validation rows count once each. States are written
    to ``folder``, from which a training that was cut short goes on; with them the
    temperature that calibrates the confidence on the validation rows."""
    weighted = _weighted(train, label_col)
    feats = Pipeline(stages=[_label_indexer(label_col), *stages, VectorAssembler(inputCols=inputs, outputCol="features")]).fit(weighted)
    both = weighted.withColumn("train", F.lit(True)).unionByName(val.withColumns({"weight": F.lit(1.0), "train": F.lit(False)}))
    rows = materialize(ep.pack(feats.transform(both)), "model_features")
    trained = ep.train_epochs(rows, len(feats.stages[0].labels), folder, max_epochs, patience, by, penalty)
    last = ep.regression_model(trained.weights)
    held = ep.held_out_probabilities(rows, trained.weights)
    found = rows.sparkSession.createDataFrame([(em.fit_temperature(held, "p", "label_idx"),)], "temperature double")
    found.coalesce(1).write.mode("overwrite").parquet(f"{folder}/temperature")
    return PipelineModel(stages=[*feats.stages, last])


def temperature_of(spark: SparkSession, folder: str) -> float:
    """M7: the temperature that the validation rows of a model's training gave."""
    return spark.read.parquet(f"{folder}/temperature").first()[0]


def text_stages(train: DataFrame, text_col: str, nota_col: str | None = None, also: DataFrame | None = None, prefix: str = "") -> tuple[list, list[str]]:
    """M3: stages and input columns of (note one-hot +) text features."""
    note, inputs = _note_stages(train, nota_col, also)
    return [*note, *text_feature_stages(text_col, prefix)], [*inputs, f"{prefix}tfidf"]


def vector_stages(train: DataFrame, nota_col: str | None = None, also: DataFrame | None = None) -> tuple[list, list[str]]:
    """M4: stages and input columns of (note one-hot +) an embedding (see :func:`vectorize`)."""
    note, inputs = _note_stages(train, nota_col, also)
    return note, [*inputs, "__vec"]


def _note_stages(train: DataFrame, nota_col: str | None, also: DataFrame | None) -> tuple[list, list[str]]:
    if not nota_col:
        return [], []
    return [_category_stage(train, nota_col, also), mp.one_hot_encoder(f"{nota_col}_idx", f"{nota_col}_vec")], [f"{nota_col}_vec"]


def content_key(df: DataFrame, cols: list[str], meta: dict) -> str:
    """A name for a model trained on these rows, in any order, with these
    parameters: the number of rows and two sums of their hashes."""
    sums = [F.sum(F.xxhash64(F.lit(seed), *cols).cast("decimal(38,0)")).cast("string") for seed in (1, 2)]
    found = df.agg(F.count(F.lit(1)), *sums).first()
    return hashlib.sha256(json.dumps([*map(str, found), cols, meta], sort_keys=True).encode()).hexdigest()[:32]


def fit_or_reuse(rows: DataFrame, cols: list[str], label_col: str, meta: dict, fit: Callable[[str], PipelineModel]) -> tuple[PipelineModel, str]:
    """M8 by content: the model saved under these rows and parameters, else
    ``fit(folder)``, saved there; with it its folder, which holds the history too.

    ``rows`` are all rows that training reads (labelled, validation, target) and
    ``cols`` the columns it reads from them."""
    spark = rows.sparkSession
    folder = shared_path(spark, f"model_{content_key(rows, cols, meta)}")
    classes = rows.where(F.col(label_col).isNotNull()).select(label_col).distinct()
    return fit_or_load(spark, folder, classes, meta, lambda: fit(folder)), folder


def epoch_history(spark: SparkSession, folder: str) -> DataFrame:
    """M9: epoch, training loss, validation loss and macro F1 of a model's training."""
    return ep.read_metrics(spark, folder)


def training_history(model: PipelineModel) -> DataFrame:
    """M9: objective per iteration of the final iterative classifier."""
    last = model.stages[-1]
    hist = list(last.summary.objectiveHistory) if getattr(last, "hasSummary", False) else []
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(hist)], "iteration int, loss double")


def two_stage_infer(
    comments: DataFrame,
    text_col: str,
    stage1: PipelineModel,
    stage2: PipelineModel,
    threshold: float = em.REVIEW_THRESHOLD,
    temperatures: tuple[float, float] = (1.0, 1.0),
) -> DataFrame:
    """Class with confidence, then consistency code on the context text
    built from the *predicted* class; review when either confidence is below
    ``threshold`` (compared before rounding)."""
    s1 = decode_prediction(stage1.transform(comments), stage1, "classificacao", prefix="s1_", temperature=temperatures[0])
    s1 = s1.select(*comments.columns, "classificacao", F.col("s1_confidence").alias("c1"))
    s1 = s1.withColumn("__ctx", mp.stage2_text(F.col("classificacao"), F.col(text_col)))
    s2 = decode_prediction(stage2.transform(s1), stage2, "sigla", prefix="s2_", temperature=temperatures[1])
    return s2.select(
        F.col(text_col).alias("comentario"),
        *[c for c in comments.columns if c != text_col],
        "classificacao",
        F.round("c1", 3).alias("confianca_classificacao"),
        "sigla",
        F.round("s2_confidence", 3).alias("confianca_sigla"),
        ((F.col("c1") < threshold) | (F.col("s2_confidence") < threshold)).alias("revisar_manualmente"),
    )


# -- S8 / S9 / M8 ---------------------------------------------------------------------


def save_model(model: PipelineModel, path: str, classes: DataFrame, meta: dict | None = None) -> None:
    """Pipeline + class table + metadata side by side."""
    model.write().overwrite().save(f"{path}/pipeline")
    classes.coalesce(1).write.mode("overwrite").parquet(f"{path}/classes")
    spark = classes.sparkSession
    spark.createDataFrame([(json.dumps(meta or {}, ensure_ascii=False),)], "meta string").coalesce(1).write.mode(
        "overwrite"
    ).json(f"{path}/meta")


def fit_or_load(
    spark: SparkSession, path: str, classes: DataFrame, meta: dict, fit: Callable[[], PipelineModel]
) -> PipelineModel:
    """M8 in the training flow: a compatible saved model, else a new one, saved."""
    model = load_if_compatible(spark, path, classes, meta)
    if model is None:
        model = fit()
        save_model(model, path, classes, meta)
    return model


def load_if_compatible(spark: SparkSession, path: str, classes: DataFrame, meta: dict | None = None) -> PipelineModel | None:
    """M8: reuse a saved model only if its class table has the same contents
    (not just the same size) and the same metadata; else None (retrain)."""
    try:
        saved = spark.read.parquet(f"{path}/classes")
        saved_meta = json.loads(spark.read.json(f"{path}/meta").first()["meta"])
    except AnalysisException:  # nothing saved yet (path does not exist)
        return None
    same = saved.exceptAll(classes).isEmpty() and classes.exceptAll(saved).isEmpty()
    if not same or saved_meta != (meta or {}):
        return None
    return PipelineModel.load(f"{path}/pipeline")
