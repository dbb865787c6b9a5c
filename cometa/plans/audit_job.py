"""End-to-end audit job (V18 / the desktop flow): load, normalize, reset,
label, write, then statistics over the written table."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cometa.operators import stats
from cometa.session import materialize
from cometa.operators.validate import audit, reset_analysis, resolve_roles, standardize_analysis
from cometa.sources.csv_audit import csv_reader, read_audit_csv, validated_path, write_validated

ANALYSIS = "ANÁLISE"


@dataclass
class AuditRun:
    validated: DataFrame
    before_totals: DataFrame
    distribution: DataFrame
    kpi: DataFrame
    badges: DataFrame
    crosstab: DataFrame | None
    worst: DataFrame | None
    run_log: DataFrame
    nota_col: str | None
    comment_col: str | None


def prepare(df: DataFrame, analysis_col: str = ANALYSIS) -> tuple[DataFrame, str | None, str | None]:
    """P2a + P4 + P5: find roles, standardize the analysis column, and clear
    every existing label except on the manual note."""
    nota_col, comment_col, _ = resolve_roles(df.columns)
    df, existed = standardize_analysis(df, analysis_col)
    if existed:
        df = reset_analysis(df, nota_col, analysis_col)
    return df, nota_col, comment_col


def run_audit(
    spark: SparkSession,
    input_path: str,
    output_path: str | None = None,
    sep: str = ";",
    multi_line: bool = True,
    fmt: str = "parquet",
    analyze: bool = True,
    legacy_last_match: bool = False,
    run_log_path: str | None = None,
) -> AuditRun:
    """Audit the extracts under ``input_path`` into ``output_path`` (default: ``<input>_VALIDADO`` beside the input)."""
    t0 = time.time()
    output_path = output_path or validated_path(input_path)
    df = read_audit_csv(spark, input_path, sep=sep, multi_line=multi_line)
    df, nota_col, comment_col = prepare(df)
    before = stats.audit_totals(df, ANALYSIS)
    validated = audit(df, comment_col=comment_col, nota_col=nota_col, analysis_col=ANALYSIS,
                      legacy_last_match=legacy_last_match)
    write_validated(validated, output_path, fmt=fmt, sep=sep)
    # statistics read the written table: the audit is not recomputed
    if fmt == "csv":  # quoted fields may hold newlines: the extract reader's options
        persisted = csv_reader(spark, sep, multi_line=True).csv(output_path)
    else:
        persisted = spark.read.format(fmt).load(output_path)
    # one aggregation over the written table: rows per (note, label), at most
    # notes x labels rows; every statistic below is derived from it
    nota_written = nota_col if nota_col in persisted.columns else None
    counts = stats.note_label_counts(persisted, nota_written, ANALYSIS)
    counts = materialize(counts, "audit_counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    run_log = stats.run_log_row(spark, total, time.time() - t0, output_path)
    if run_log_path:
        stats.append_run_log(run_log, run_log_path)
    w = "n"
    return AuditRun(
        validated=persisted,
        before_totals=before,
        distribution=stats.label_distribution(counts, "analise", weight_col=w).withColumnRenamed("analise", ANALYSIS),
        kpi=stats.conformity_kpi(counts, "analise", weight_col=w),
        badges=stats.label_badges(counts, "analise", weight_col=w),
        crosstab=stats.note_label_crosstab(counts, "nota", "analise", weight_col=w)
        .withColumnsRenamed({"nota": nota_written, "analise": ANALYSIS})
        if analyze and nota_written
        else None,
        worst=stats.worst_notes(counts, "nota", "analise", weight_col=w).withColumnRenamed("nota", nota_written)
        if analyze and nota_written
        else None,
        run_log=run_log,
        nota_col=nota_col,
        comment_col=comment_col,
    )
