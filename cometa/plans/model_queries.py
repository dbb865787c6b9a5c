"""Registered model queries (training + inference).

Predicted values cannot be matched across libraries, so the queries that return
them have no oracle SQL. Each has a contract query beside it that does: one row
per row to predict, with what must hold of it (a known class, probabilities that
sum to 1, a review flag that says confidence < 0.6, kept rows unchanged).
Training runs jobs while the query is built, once for the same rows and parameters:
models are saved under a name made from both. ``epoch_history`` trains on stored
vectors, which SQL can do too, epoch by epoch, so its losses have an oracle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cometa.operators import evalmetrics as em
from cometa.operators import mlprep as mp
from cometa.operators import models as md
from cometa.operators.category_stats import fold_of
from cometa.operators.embed_cache import embed_with_cache
from cometa.operators.epochs import regression_model, train_epochs
from cometa.plans.audit_queries import aud
from cometa.plans.joins import lookup_join
from cometa.plans.ml_queries import docs
from cometa.session import materialize, shared_path
from cometa.sources.tables import table


def rf_predict(spark, sf_dir):
    """M1/M2 + U2 on the audit table: fill missing labels by random forest."""
    a = aud(spark, sf_dir)
    out = md.forest_fill(a, "nota", "comentario", "analise_previa", trees=100, seed=42)
    return out.select("k", "nota", "comentario", F.col("analise_previa").alias("analise"), "origin")


def rf_contract(spark, sf_dir):
    """M1/M2 contract: every row once; a kept label is unchanged, a filled one is a class of training."""
    classes = aud(spark, sf_dir).where(F.col("analise_previa").isNotNull()).select(F.col("analise_previa").alias("analise")).distinct()
    # a written list, so that Spark knows its size and does not deal all rows by their few classes
    rows = lookup_join(rf_predict(spark, sf_dir), classes.withColumn("known", F.lit(True)), "analise")
    kept = F.when(F.col("origin") == "kept", F.col("analise"))
    return rows.select("k", "nota", "comentario", "origin", kept.alias("kept_label"), F.coalesce("known", F.lit(False)).alias("known_class"))


def _text_docs(spark, sf_dir) -> DataFrame:
    """Documents with the text cast that training uses (a null text is 'nan')."""
    return docs(spark, sf_dir).withColumn("text", mp.as_text(F.col("text")))


def _split(d: DataFrame, label_col: str, share: float) -> DataFrame:
    """Rows of classes with two rows or more and their ``split``; only class tables are written here."""
    return mp.stratified_split(mp.drop_rare_classes(d, label_col), label_col, "doc_id", train_share=share, seed=42, written=True)


def _parts(split: DataFrame) -> tuple[DataFrame, DataFrame]:
    return split.where("split = 'train'"), split.where("split = 'val'")


@dataclass
class Training:
    """A trained or reused model, the folder of its history, and the rows around it."""

    model: PipelineModel
    folder: str
    val: DataFrame
    todo: DataFrame


def _text_training(spark, sf_dir) -> Training:
    """M3 + M8 + M9; trained once for the same rows, then read back."""
    d = _text_docs(spark, sf_dir)
    train_all, todo = mp.split_labelled(d, "label")
    split = _split(train_all, "label", 0.8)

    def fit(folder):
        train, val = _parts(materialize(split, "text_split"))
        stages, inputs = md.text_stages(train, "text", "source", todo)
        return md.fit_by_epochs(train, val, stages, inputs, "label", folder, patience=3, max_epochs=20)

    meta = {"model": "text", "features": md.TEXT_FEATURES, "patience": 3, "epochs": 20, "share": 0.8}
    model, folder = md.fit_or_reuse(d, ["doc_id", "text", "source", "label"], "label", meta, fit)
    return Training(model, folder, _parts(split)[1], todo)


def _text_model(spark, sf_dir):
    t = _text_training(spark, sf_dir)
    return t.model, t.val, t.todo


def _embedding_training(spark, sf_dir) -> Training:
    """M4 + J2/E6, likewise."""
    d = _text_docs(spark, sf_dir)
    emb = embed_with_cache(d, "text", shared_path(spark, "embedding_cache"))
    train_all, todo = mp.split_labelled(emb, "label")
    split = _split(train_all, "label", 0.8)

    def fit(folder):
        train, val = _parts(materialize(split, "embedding_split"))
        stages, inputs = md.vector_stages(train, "source", todo)
        return md.fit_by_epochs(md.vectorize(train, "embedding"), md.vectorize(val, "embedding"), stages, inputs, "label", folder, patience=4, max_epochs=30)

    meta = {"model": "embedding", "patience": 4, "epochs": 30, "share": 0.8}
    model, folder = md.fit_or_reuse(d, ["doc_id", "text", "source", "label"], "label", meta, fit)
    return Training(model, folder, md.vectorize(_parts(split)[1], "embedding"), md.vectorize(todo, "embedding"))


def _predicted(model, todo, temperature: float = 1.0) -> DataFrame:
    return md.decode_prediction(model.transform(todo), model, "pred_label", total_col="total", temperature=temperature)


def _calibrated(spark, t: Training) -> DataFrame:
    return _predicted(t.model, t.todo, md.temperature_of(spark, t.folder))


def _prediction(spark, t: Training) -> DataFrame:
    return _calibrated(spark, t).select(
        "doc_id",
        F.col("pred_label").alias("label"),
        F.col("confidence").alias("confianca_previsao"),
        F.col("review").alias("revisar_manualmente"),
    )


def _contract(spark, sf_dir, t: Training) -> DataFrame:
    trained = mp.class_support(docs(spark, sf_dir), "label").where(F.col("n") >= 2)
    classes = trained.select(F.col("label").alias("pred_label"), F.lit(True).alias("known"))
    out = _calibrated(spark, t).join(classes, "pred_label", "left")
    return out.select(
        "doc_id",
        F.coalesce("known", F.lit(False)).alias("known_class"),
        (F.abs(F.col("total") - 1) < 1e-9).alias("sums_to_one"),
        (F.col("review") == (F.col("confidence") < em.REVIEW_THRESHOLD)).alias("flag_is_threshold"),
    )


def text_predict(spark, sf_dir):
    """M3 + M7: source + text n-grams -> class of unlabelled documents."""
    return _prediction(spark, _text_training(spark, sf_dir))


def embedding_predict(spark, sf_dir):
    """M4 + J2/E6: source + cached text embedding -> class."""
    return _prediction(spark, _embedding_training(spark, sf_dir))


def text_contract(spark, sf_dir):
    return _contract(spark, sf_dir, _text_training(spark, sf_dir))


def embedding_contract(spark, sf_dir):
    return _contract(spark, sf_dir, _embedding_training(spark, sf_dir))


def text_report(spark, sf_dir):
    """A12 of M3 on its held-out split, by class."""
    model, val, _ = _text_model(spark, sf_dir)
    return md.evaluate(model, val, "label")[0]


def text_history(spark, sf_dir):
    """M9 of M3: losses and macro F1 by epoch."""
    return md.epoch_history(spark, _text_training(spark, sf_dir).folder)


def _vector_rows(spark, sf_dir) -> DataFrame:
    """Vectors with their label's index; one in five, by the MD5 of its id, is a validation row."""
    e = table(spark, sf_dir, "embeddings").where(F.col("embedding").isNotNull() & F.col("label").isNotNull())
    e = e.withColumn("train", fold_of(F.col("vec_id")) != 0)
    weights = mp.balanced_class_weights(e.where("train"), "label").select("label", F.col("weight").alias("own"))
    places = F.row_number().over(Window.orderBy("label")) - 1  # over the class table
    weights = materialize(weights.withColumn("label_idx", places.cast("double")), "vector_classes")
    rows = e.join(weights, "label").withColumn("weight", F.when(F.col("train"), F.col("own")).otherwise(1.0))
    return rows.select("vec_id", "train", "label_idx", "weight", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))


def _vector_training(spark, sf_dir):
    """S9 + M4: twelve epochs at most, patience 3, best by validation loss, on the stored vectors."""
    rows = materialize(_vector_rows(spark, sf_dir), "vector_rows")
    classes = rows.select("label_idx").distinct().count()
    named = rows.select("vec_id", "train", "label_idx", vector_to_array("features").alias("f"))
    folder = shared_path(spark, f"model_{md.content_key(named, named.columns, {'model': 'vectors', 'patience': 3, 'epochs': 12})}")
    return rows, train_epochs(rows, classes, folder, max_epochs=12, patience=3)


def epoch_history(spark, sf_dir):
    """S9 + M9: losses and macro F1 by epoch, and which epoch is kept."""
    history = _vector_training(spark, sf_dir)[1].history
    return history.select("epoch", *[F.round(c, 6).alias(c) for c in ("train_loss", "val_loss", "val_macro_f1")], "best")


def calibration(spark, sf_dir):
    """M7: log loss, calibration error and rows to review of the kept epoch's
    probabilities on the validation rows, before and after the temperature fitted on them."""
    rows, trained = _vector_training(spark, sf_dir)
    held = regression_model(trained.weights).transform(rows.where(~F.col("train"))).select("label_idx", vector_to_array("probability").alias("p"))
    held = materialize(held, "vector_probabilities")
    t = em.fit_temperature(held, "p", "label_idx")

    def judged(df, stage, value):
        c = em.calibration(df, "p", "label_idx")
        return c.select(F.lit(stage).alias("stage"), F.round(F.lit(value), 5).alias("temperature"), *[F.round(x, 6).alias(x) for x in ("log_loss", "calibration_error")], "n_review", "n")

    return judged(held, "before", 1.0).unionByName(judged(em.with_temperature(held, "p", t, "p"), "after", t))



def embedding_join(spark, sf_dir):
    """Every document with whether it has a vector, and of length 1."""
    emb = embed_with_cache(docs(spark, sf_dir), "text", shared_path(spark, "embedding_cache"))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return emb.select("doc_id", F.col("embedding").isNotNull().alias("has_vector"), F.round(norm, 3).alias("norm"))


def _two_stages(spark, sf_dir):
    """M5: stage 1 text -> source class; stage 2 (class, text) -> OK or TOX,
    trained on the column that inference builds."""
    lab, todo = mp.split_labelled(_text_docs(spark, sf_dir), "label")
    lab = lab.withColumn("sigla", F.when(F.col("toxic") == 1, "TOX").otherwise("OK"))
    ctx = lab.withColumn("__ctx", mp.stage2_text(F.col("source"), F.col("text")))

    def stage(rows, text_col, label_col, prefix):
        def fit(folder):
            train, val = _parts(materialize(_split(rows, label_col, 0.85), f"{prefix}_split"))
            stages, inputs = md.text_stages(train, text_col, prefix=prefix)
            return md.fit_by_epochs(train, val, stages, inputs, label_col, folder, by="macro_f1", patience=3, max_epochs=20)

        meta = {"model": prefix, "features": md.TEXT_FEATURES, "by": "macro_f1", "patience": 3, "epochs": 20, "share": 0.85}
        return md.fit_or_reuse(rows, ["doc_id", text_col, label_col], label_col, meta, fit)

    (stage1, folder1), (stage2, folder2) = stage(lab, "text", "source", "s1"), stage(ctx, "__ctx", "sigla", "s2")
    return stage1, stage2, todo, (md.temperature_of(spark, folder1), md.temperature_of(spark, folder2))


def two_stage_infer(spark, sf_dir):
    """M5 + M10 on unlabelled documents."""
    stage1, stage2, todo, temperatures = _two_stages(spark, sf_dir)
    return md.two_stage_infer(todo.select("doc_id", "text"), "text", stage1, stage2, temperatures=temperatures)


def two_stage_contract(spark, sf_dir):
    """M10 contract: one row per unlabelled document; codes of the alphabet; confidences in range."""
    out = two_stage_infer(spark, sf_dir)
    sure = [F.col(c).between(0, 1) for c in ("confianca_classificacao", "confianca_sigla")]
    low = F.least("confianca_classificacao", "confianca_sigla")
    # the flag compares before rounding to 3 places
    flag = F.when(F.col("revisar_manualmente"), low <= em.REVIEW_THRESHOLD).otherwise(low >= em.REVIEW_THRESHOLD)
    return out.select(
        "doc_id",
        F.col("sigla").isin("OK", "TOX").alias("known_code"),
        F.col("classificacao").isNotNull().alias("has_class"),
        (sure[0] & sure[1]).alias("in_range"),
        flag.alias("flag_is_threshold"),
    )


def _vector_predicted(spark, sf_dir) -> DataFrame:
    """The kept epoch's predictions of the validation rows, written once."""
    rows, trained = _vector_training(spark, sf_dir)
    held = regression_model(trained.weights).transform(rows.where(~F.col("train")))
    held = em.with_confidence(held.select("vec_id", F.col("label_idx").cast("int").alias("label_idx"), vector_to_array("probability").alias("p")), "p")
    return materialize(held, "vector_predictions")


def vector_predict(spark, sf_dir):
    """M4 + M7 on stored vectors: class, confidence and review flag of each validation row."""
    p = _vector_predicted(spark, sf_dir)
    return p.select("vec_id", "label_idx", "pred_idx", F.round("confidence", 6).alias("confidence"), "review")


def vector_report(spark, sf_dir):
    """A11 + A12 of that model, from its written predictions."""
    report = em.per_class_report(em.confusion_counts(_vector_predicted(spark, sf_dir), "label_idx", "pred_idx"))
    return report.select(F.col("label").cast("int").alias("label"), *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


QUERIES = {
    "rf_predict": rf_predict,
    "rf_contract": rf_contract,
    "text_predict": text_predict,
    "text_contract": text_contract,
    "text_report": text_report,
    "text_history": text_history,
    "epoch_history": epoch_history,
    "calibration": calibration,
    "vector_predict": vector_predict,
    "vector_report": vector_report,
    "embedding_predict": embedding_predict,
    "embedding_contract": embedding_contract,
    "embedding_join": embedding_join,
    "two_stage_infer": two_stage_infer,
    "two_stage_contract": two_stage_contract,
}

_TODO = "FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"


def _epoch_sql(epochs: int = 12, patience: int = 3, penalty: float = 0.001, momentum: float = 0.9) -> str:
    """The epochs written out: scores, losses and gradients of all rows by joins with the coefficients."""
    steps = [
        """base AS MATERIALIZED (SELECT vec_id, label, embedding, ('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 8))::BIGINT % 5 <> 0 AS train
          FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL)""",
        """classes AS MATERIALIZED (SELECT label, row_number() OVER (ORDER BY label) - 1 AS c, sum(count(*)) OVER () / (count(*) OVER () * count(*)) AS own
          FROM base WHERE train GROUP BY label)""",
        "kept AS MATERIALIZED (SELECT vec_id, train, c AS y, CASE WHEN train THEN own ELSE 1.0 END AS weight, embedding FROM base JOIN classes USING (label))",
        """cells AS MATERIALIZED (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS j FROM kept
          UNION ALL SELECT vec_id, 1.0, 0 FROM kept)""",
        f"""step AS (SELECT 1.0 / (0.5 * (max(s) + 1.0) + {penalty}) AS step FROM (SELECT sum(x * x) AS s FROM cells JOIN kept USING (vec_id) WHERE train AND j > 0 GROUP BY vec_id))""",
        "w0 AS MATERIALIZED (SELECT j, c, 0.0::DOUBLE AS w, 0.0::DOUBLE AS v FROM (SELECT DISTINCT j FROM cells) CROSS JOIN classes)",
    ]
    for k in range(epochs + 1):
        steps += [
            f"s{k} AS MATERIALIZED (SELECT vec_id, c, exp(sum(x * w)) AS e FROM cells JOIN w{k} USING (j) GROUP BY vec_id, c)",
            f"p{k} AS MATERIALIZED (SELECT vec_id, train, y, weight, c, e / sum(e) OVER (PARTITION BY vec_id) AS p, row_number() OVER (PARTITION BY vec_id ORDER BY e DESC, c) AS place FROM s{k} JOIN kept USING (vec_id))",
            f"f{k} AS (SELECT avg(2.0 * hit / (truth + said)) AS f FROM (SELECT c, sum(CASE WHEN y = c AND place = 1 THEN 1 ELSE 0 END) AS hit, sum(CASE WHEN y = c THEN 1 ELSE 0 END) AS truth, sum(CASE WHEN place = 1 THEN 1 ELSE 0 END) AS said FROM p{k} WHERE NOT train GROUP BY c) WHERE truth + said > 0)",
            f"""m{k} AS MATERIALIZED (SELECT {k} AS epoch,
              (SELECT sum(-ln(p) * weight) / sum(weight) FROM p{k} WHERE train AND c = y) + 0.5 * {penalty} * (SELECT sum(w * w) FROM w{k} WHERE j > 0) AS train_loss,
              (SELECT sum(-ln(p)) / count(*) FROM p{k} WHERE NOT train AND c = y) AS val_loss, (SELECT f FROM f{k}) AS val_macro_f1)""",
        ]
        if k < epochs:
            steps.append(
                f"""w{k + 1} AS MATERIALIZED (SELECT j, c, w + nv AS w, nv AS v FROM (SELECT w{k}.j, w{k}.c, w, {momentum} * v - step * (g + CASE WHEN w{k}.j > 0 THEN {penalty} * w ELSE 0.0 END) AS nv
                FROM w{k} JOIN (SELECT j, c, sum(x * weight * (p - CASE WHEN c = y THEN 1.0 ELSE 0.0 END)) / (SELECT sum(weight) FROM kept WHERE train) AS g
                  FROM p{k} JOIN cells USING (vec_id) WHERE train GROUP BY j, c) USING (j, c) CROSS JOIN step))"""
            )
    every = " UNION ALL ".join(f"SELECT * FROM m{k}" for k in range(epochs + 1))
    steps += [
        f"m AS MATERIALIZED ({every})",
        "upto AS (SELECT a.epoch, arg_min(b.epoch, b.val_loss) AS lead FROM m a JOIN m b ON b.epoch BETWEEN 1 AND a.epoch GROUP BY a.epoch)",
        f"last AS MATERIALIZED (SELECT coalesce(min(CASE WHEN epoch - lead >= {patience} THEN epoch END), {epochs}) AS epoch FROM upto)",
        "kept_epoch AS MATERIALIZED (SELECT lead FROM upto JOIN last USING (epoch))",
    ]
    return "WITH " + ", ".join(steps)


EPOCH_HISTORY = (
    _epoch_sql()
    + """ SELECT m.epoch, round(train_loss, 6) AS train_loss, round(val_loss, 6) AS val_loss, round(val_macro_f1, 6) AS val_macro_f1,
      m.epoch = (SELECT lead FROM kept_epoch) AS best FROM m CROSS JOIN last WHERE m.epoch <= last.epoch"""
)


def _held_sql(epochs: int = 12) -> str:
    """The kept epoch's probabilities of the validation rows: vec_id, y, c, p; then the first greatest of each row."""
    held = " UNION ALL ".join(f"SELECT {k} AS epoch, vec_id, y, c, p FROM p{k} WHERE NOT train" for k in range(1, epochs + 1))
    return f"""{_epoch_sql()}, chosen AS MATERIALIZED (SELECT vec_id, y, c, p FROM ({held}) WHERE epoch = (SELECT lead FROM kept_epoch)),
    said AS MATERIALIZED (SELECT vec_id, y, c, p FROM chosen QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, c) = 1)"""


VECTOR_PREDICT = (
    _held_sql()
    + " SELECT vec_id, CAST(y AS INTEGER) AS label_idx, CAST(c AS INTEGER) AS pred_idx, round(p, 6) AS confidence, p < 0.6 AS review FROM said"
)
VECTOR_REPORT = (
    _held_sql()
    + """, per AS (SELECT label, sum(hit) AS hit, sum(truth) AS truth, sum(pred) AS pred FROM (
      SELECT y AS label, CAST(y = c AS INTEGER) AS hit, 1 AS truth, 0 AS pred FROM said UNION ALL SELECT c, 0, 0, 1 FROM said) GROUP BY label),
    q AS (SELECT label, CASE WHEN pred > 0 THEN hit / pred ELSE 0.0 END AS pr, CASE WHEN truth > 0 THEN hit / truth ELSE 0.0 END AS re, truth FROM per)
    SELECT CAST(label AS INTEGER) AS label, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0.0 END, 6) AS f1, CAST(truth AS BIGINT) AS support FROM q"""
)


def _calibration_sql(steps: int = 8, epochs: int = 12) -> str:
    """The kept epoch's probabilities of the validation rows, then Newton's steps written out."""
    held = " UNION ALL ".join(f"SELECT {k} AS epoch, vec_id, y, c, p FROM p{k} WHERE NOT train" for k in range(1, epochs + 1))
    ctes = [f"held AS MATERIALIZED (SELECT vec_id, y, c, ln(p) AS z FROM ({held}) WHERE epoch = (SELECT lead FROM kept_epoch))", "b0 AS (SELECT 1.0::DOUBLE AS b)"]
    for k in range(steps):
        ctes += [
            f"q{k} AS (SELECT vec_id, sum(exp(b * z) * z) / sum(exp(b * z)) AS one, sum(exp(b * z) * z * z) / sum(exp(b * z)) AS two, max(CASE WHEN c = y THEN z END) AS own FROM held CROSS JOIN b{k} GROUP BY vec_id)",
            f"b{k + 1} AS MATERIALIZED (SELECT least(20.0, greatest(0.05, b + (SELECT avg(own - one) / avg(two - one * one) FROM q{k}))) AS b FROM b{k})",
        ]
    for stage, b in (("before", "b0"), ("after", f"b{steps}")):
        ctes += [
            f"s_{stage} AS (SELECT vec_id, y, c, exp(b * z) / sum(exp(b * z)) OVER (PARTITION BY vec_id) AS p FROM held CROSS JOIN {b})",
            f"r_{stage} AS (SELECT vec_id, -ln(max(CASE WHEN c = y THEN p END)) AS loss, max(p) AS said, CAST(arg_max(c, p) = max(y) AS INTEGER) AS hit FROM s_{stage} GROUP BY vec_id)",
            f"e_{stage} AS (SELECT least(floor(said * 10), 9) AS bin, sum(loss) AS loss, sum(said) AS said, sum(hit) AS hit, count(*) FILTER (WHERE said < 0.6) AS review, count(*) AS n FROM r_{stage} GROUP BY 1)",
        ]
    rows = [
        f"""SELECT '{stage}' AS stage, round(1.0 / (SELECT b FROM {b}), 5) AS temperature, round(sum(loss) / sum(n), 6) AS log_loss,
          round(sum(abs(said - hit)) / sum(n), 6) AS calibration_error, CAST(sum(review) AS BIGINT) AS n_review, CAST(sum(n) AS BIGINT) AS n FROM e_{stage}"""
        for stage, b in (("before", "b0"), ("after", f"b{steps}"))
    ]
    return f"{_epoch_sql()}, {', '.join(ctes)} {' UNION ALL '.join(rows)}"


def oracles(audit_table: str) -> dict[str, str]:
    return {
        "rf_contract": f"""SELECT k, nota, comentario, CASE WHEN analise_previa IS NULL THEN 'filled' ELSE 'kept' END AS origin,
            analise_previa AS kept_label, true AS known_class FROM ({audit_table})""",
        "epoch_history": EPOCH_HISTORY,
        "calibration": _calibration_sql(),
        "vector_predict": VECTOR_PREDICT,
        "vector_report": VECTOR_REPORT,
        "text_contract": f"SELECT doc_id, true AS known_class, true AS sums_to_one, true AS flag_is_threshold {_TODO}",
        "embedding_contract": f"SELECT doc_id, true AS known_class, true AS sums_to_one, true AS flag_is_threshold {_TODO}",
        "embedding_join": "SELECT doc_id, text IS NOT NULL AS has_vector, CASE WHEN text IS NOT NULL THEN 1.0::DOUBLE END AS norm FROM documents",
        "two_stage_contract": f"SELECT doc_id, true AS known_code, true AS has_class, true AS in_range, true AS flag_is_threshold {_TODO}",
    }
