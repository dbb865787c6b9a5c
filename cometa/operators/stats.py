"""Audit statistics: distributions, totals, crosstab, worst notes, KPI, run log.

All are single aggregations with partial (map-side) aggregation, so a hot
note or label that holds a third of the rows is pre-combined in every scan
task before the shuffle; the shuffled data is one row per key per task.

Every statistic also accepts ``weight_col``: rows then count ``weight``
times. A job computes :func:`note_label_counts` once (one pass over the big
table, at most notes x labels rows) and derives all statistics from it.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cometa.operators.rules import LABELS, NON_CONFORMING

def _count_if(cond: Column, weight_col: str | None) -> Column:
    """Rows where ``cond`` holds (weighted by ``weight_col`` when given)."""
    if weight_col is None:
        return F.count_if(cond)
    return F.coalesce(F.sum(F.when(cond, F.col(weight_col))), F.lit(0)).cast("bigint")


def note_label_counts(df: DataFrame, nota_col: str | None, analysis_col: str = "analise") -> DataFrame:
    """``(nota, analise, n)``: rows per (note, label), null keys kept.

    One aggregation over the big table; pass the result with
    ``weight_col="n"`` to the statistics below.
    """
    nota = F.col(nota_col) if nota_col else F.lit(None).cast("string")
    return df.groupBy(nota.alias("nota"), F.col(analysis_col).alias("analise")).agg(F.count(F.lit(1)).alias("n"))


def label_distribution(
    df: DataFrame, analysis_col: str = "analise", out_col: str = "n", weight_col: str | None = None
) -> DataFrame:
    """A1: count per non-null label, count-descending (label breaks ties).

    The null group is dropped *after* aggregating (``count(label) > 0``): a
    filter on the label before the aggregate would be pushed below the
    projection that computes the label and evaluate the audit twice.
    """
    a = F.col(analysis_col)
    return (
        df.groupBy(a.alias(analysis_col))
        .agg(_count_if(a.isNotNull(), weight_col).alias(out_col))
        .where(F.col(out_col) > 0)
        .orderBy(F.desc(out_col), F.asc(analysis_col))
    )


def audit_totals(df: DataFrame, analysis_col: str = "analise", weight_col: str | None = None) -> DataFrame:
    """A2: total rows, rows with a label, rows without."""
    a = F.col(analysis_col)
    return df.agg(
        _count_if(F.lit(True), weight_col).alias("total_rows"),
        _count_if(a.isNotNull(), weight_col).alias("filled_rows"),
        _count_if(a.isNull(), weight_col).alias("empty_rows"),
    )


def note_label_crosstab(
    df: DataFrame, nota_col: str = "nota", analysis_col: str = "analise", weight_col: str | None = None
) -> DataFrame:
    """A3: rows per (note, label), every label that occurs, in long form
    ``(note, label, n)``. Rows with a null note or label are dropped."""
    a = F.col(analysis_col)
    return (
        df.where(F.col(nota_col).isNotNull())
        .groupBy(F.col(nota_col).alias(nota_col), a.alias(analysis_col))
        .agg(_count_if(a.isNotNull(), weight_col).alias("n"))
        .where(F.col("n") > 0)
        .orderBy(nota_col, analysis_col)
    )


def wide_crosstab(long: DataFrame, labels: list[str], nota_col: str = "nota", analysis_col: str = "analise") -> DataFrame:
    """A3 as one column per given label, zeros filled; ``long`` comes from
    :func:`note_label_crosstab`. Labels that are not given have no column."""
    cells = [F.coalesce(F.sum(F.when(F.col(analysis_col) == x, F.col("n"))), F.lit(0)).alias(x) for x in labels]
    return long.groupBy(nota_col).agg(*cells).orderBy(nota_col)


def worst_notes(
    df: DataFrame, nota_col: str = "nota", analysis_col: str = "analise", top: int = 10, weight_col: str | None = None
) -> DataFrame:
    """A4 + O1: notes with most non-conforming rows, top ``top``.

    A null label counts as non-conforming (``IS DISTINCT FROM 'C'``); a null
    note is dropped. The note name breaks count ties.
    """
    return (
        df.where(F.col(nota_col).isNotNull())
        .groupBy(F.col(nota_col).alias(nota_col))
        .agg(_count_if(~F.col(analysis_col).eqNullSafe("C"), weight_col).alias("n_nonconforming"))
        .where(F.col("n_nonconforming") > 0)
        .orderBy(F.desc("n_nonconforming"), F.asc(nota_col))
        .limit(top)
    )


def _pt_br_percent(x: Column) -> Column:
    return F.translate(F.format_string("%.2f%%", x), ".", ",")


def conformity_kpi(df: DataFrame, analysis_col: str = "analise", weight_col: str | None = None) -> DataFrame:
    """A5 + A6: non-conforming / conforming x 100, with the pt-BR text.

    ``C = 0`` gives ``0,0%`` when there is nothing non-conforming and ``N/A``
    otherwise; null labels count in neither side.
    """
    a = F.col(analysis_col)
    counts = df.agg(
        _count_if(a == "C", weight_col).alias("total_c"),
        _count_if(a.isin(NON_CONFORMING), weight_col).alias("total_nonconforming"),
    )
    ratio = F.try_divide(F.col("total_nonconforming").cast("double"), F.col("total_c").cast("double")) * 100.0
    return counts.select(
        "total_c",
        "total_nonconforming",
        F.when(F.col("total_c") > 0, ratio).alias("ratio_pct"),
        F.when(F.col("total_c") > 0, _pt_br_percent(ratio))
        .when(F.col("total_nonconforming") == 0, "0,0%")
        .otherwise("N/A")
        .alias("ratio_text"),
    )


def label_badges(df: DataFrame, analysis_col: str = "analise", weight_col: str | None = None) -> DataFrame:
    """One row per label of the alphabet with its count and pt-BR text
    (thousands separated by '.'); labels absent from the data show 0."""
    a = F.col(analysis_col)
    counts = df.agg(*[_count_if(a == lbl, weight_col).alias(lbl) for lbl in LABELS])
    stack = F.expr(
        "stack({n}, {pairs}) as (label, n)".format(
            n=len(LABELS), pairs=", ".join(f"'{lbl}', `{lbl}`" for lbl in LABELS)
        )
    )
    return counts.select(stack).select(
        "label", "n", F.translate(F.format_number(F.col("n"), 0), ",", ".").alias("n_text")
    )


RUN_LOG_SCHEMA = T.StructType(
    [
        T.StructField("run_at", T.TimestampType()),
        T.StructField("run_at_text", T.StringType()),
        T.StructField("total_rows", T.LongType()),
        T.StructField("elapsed_s", T.DoubleType()),
        T.StructField("output_path", T.StringType()),
    ]
)


def run_log_row(spark: SparkSession, total_rows: int, elapsed_s: float, output_path: str) -> DataFrame:
    """A one-row run record (timestamp, rows, elapsed seconds, output)."""
    now = _dt.datetime.now()
    text = now.strftime("%d/%m/%Y às %H:%M:%S")
    return spark.createDataFrame([(now, text, int(total_rows), round(float(elapsed_s), 1), output_path)], RUN_LOG_SCHEMA)


def append_run_log(run_row: DataFrame, log_path: str) -> None:
    """Keep every run (the desktop tool kept only the last one)."""
    run_row.coalesce(1).write.mode("append").parquet(log_path)
