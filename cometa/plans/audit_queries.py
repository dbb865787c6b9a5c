"""Registered audit queries over the derived audit table (see ``sources.derived``).

Each builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame: no job runs
before an action.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cometa.functions.text import digit_run_count, first_digit_run, has_special_char, trim_ws
from cometa.operators import stats
from cometa.operators.rules import rules_frame
from cometa.operators.validate import (
    audit,
    with_audit_label,
    has_disallowed_letters,
    only_allowed_tokens,
    reset_analysis,
)
from cometa.plans.partitioning import spread_for_cpu
from cometa.sources.derived import derived_audit_table
from cometa.sources.tables import table


def aud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived audit table; the scan is spread over the cores first when
    it has fewer splits than cores, so the derivation and the rules run in
    parallel (a no-op on a large, many-split table)."""
    return derived_audit_table(spread_for_cpu(table(spark, sf_dir, "lineitem")))


def _c():
    return trim_ws(F.col("comentario"))


def audit_rows(spark, sf_dir):
    """V0 on every row."""
    return with_audit_label(aud(spark, sf_dir), "nota", "comentario", "analise").select(
        "k", "nota", "comentario", "analise"
    )


def audit_preserve(spark, sf_dir):
    """Keep prior labels, compute the rest."""
    df = aud(spark, sf_dir).withColumn("analise", F.col("analise_previa"))
    return audit(df, comment_col="comentario", nota_col="nota", analysis_col="analise").select(
        "k", "nota", "comentario", "analise_previa", "analise"
    )


def audited(spark, sf_dir) -> DataFrame:
    """V18 flow: reset prior labels except on the manual note (P5), then
    audit keeping what is left (P6)."""
    df = aud(spark, sf_dir).withColumn("analise", F.col("analise_previa"))
    df = reset_analysis(df, "nota", "analise")
    return audit(df, comment_col="comentario", nota_col="nota", analysis_col="analise")


def audit_reset(spark, sf_dir):
    return audited(spark, sf_dir).select("k", "nota", "comentario", "analise")


def audit_special_chars(spark, sf_dir):
    return aud(spark, sf_dir).select("k", "comentario", F.coalesce(has_special_char(_c()), F.lit(False)).alias("flag"))


def audit_excess_space(spark, sf_dir):
    return aud(spark, sf_dir).select("k", "comentario", F.coalesce(_c().contains("   "), F.lit(False)).alias("flag"))


def audit_token_only(spark, sf_dir):
    return aud(spark, sf_dir).select("k", "comentario", F.coalesce(only_allowed_tokens(_c()), F.lit(False)).alias("flag"))


def audit_letters(spark, sf_dir):
    return aud(spark, sf_dir).select(
        "k", "comentario", F.coalesce(has_disallowed_letters(_c()), F.lit(False)).alias("flag")
    )


def audit_number_count(spark, sf_dir):
    return aud(spark, sf_dir).select(
        "k",
        "comentario",
        F.coalesce(digit_run_count(_c()), F.lit(0)).cast("bigint").alias("digit_runs"),
        F.coalesce(first_digit_run(_c()), F.lit("")).alias("first_run"),
    )


def _audit_notes(notes):
    def q(spark, sf_dir):
        d = aud(spark, sf_dir).where(F.col("nota").isin(notes))
        return with_audit_label(d, "nota", "comentario", "analise").select("k", "nota", "comentario", "analise")

    return q


audit_poste = _audit_notes(["E101", "E111", "P231"])
audit_medidor = _audit_notes(["B111", "P111", "P131", "T171"])
audit_funcao = _audit_notes(["T161", "T181"])
audit_sem_leitura = _audit_notes(["R111"])


def rules_join(spark, sf_dir):
    """Note -> rule lookup (left outer; a miss has no rule). The rules are
    19 constant rows, so they are broadcast as they are."""
    d = aud(spark, sf_dir).withColumn("nota_key", trim_ws(F.col("nota")))
    rules = rules_frame(spark).select(F.col("nota").alias("nota_key"), "required", "description")
    return d.join(F.broadcast(rules), "nota_key", "left").select("k", "nota", "required", "description")


def label_distribution(spark, sf_dir):
    return stats.label_distribution(audited(spark, sf_dir), "analise")


def audit_totals(spark, sf_dir):
    return stats.audit_totals(audited(spark, sf_dir), "analise")


def note_label_crosstab(spark, sf_dir):
    return stats.note_label_crosstab(audited(spark, sf_dir), "nota", "analise")


def worst_notes(spark, sf_dir):
    return stats.worst_notes(audited(spark, sf_dir), "nota", "analise", top=10)


def conformity_kpi(spark, sf_dir):
    return stats.conformity_kpi(audited(spark, sf_dir), "analise")


def label_badges(spark, sf_dir):
    return stats.label_badges(audited(spark, sf_dir), "analise")


def fill_and_merge(spark, sf_dir):
    """Rows that already had a label (``kept``) and rows labelled now
    (``filled``), in one pass over the table (row order is not part of the
    contract, so no union of two scans)."""
    df = aud(spark, sf_dir).withColumn("analise", F.col("analise_previa"))
    out = audit(df, comment_col="comentario", nota_col="nota", analysis_col="analise")
    origin = F.when(F.col("analise_previa").isNotNull(), "kept").otherwise("filled")
    return out.select("k", "nota", "comentario", "analise", origin.alias("origin"))


QUERIES = {
    "audit_rows": audit_rows,
    "audit_preserve": audit_preserve,
    "audit_reset": audit_reset,
    "audit_special_chars": audit_special_chars,
    "audit_excess_space": audit_excess_space,
    "audit_token_only": audit_token_only,
    "audit_letters": audit_letters,
    "audit_number_count": audit_number_count,
    "audit_poste": audit_poste,
    "audit_medidor": audit_medidor,
    "audit_funcao": audit_funcao,
    "audit_sem_leitura": audit_sem_leitura,
    "rules_join": rules_join,
    "label_distribution": label_distribution,
    "audit_totals": audit_totals,
    "note_label_crosstab": note_label_crosstab,
    "worst_notes": worst_notes,
    "conformity_kpi": conformity_kpi,
    "label_badges": label_badges,
    "fill_and_merge": fill_and_merge,
}
