"""Registered queries of the extract readers and small preparation steps, with
their DuckDB oracle.

The extract is the derived audit table, written as delimited files under the
shared folder in two layouts (other column order, an extra column, headers with
dots, spaces and line ends), and read back by name.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cometa.operators import mlprep as mp
from cometa.operators.validate import resolve_roles, standardize_analysis
from cometa.plans.audit_queries import aud
from cometa.plans.ml_queries import docs
from cometa.plans.oracle_audit import AUD_SQL, AUDIT_CTES
from cometa.session import shared_path
from cometa.sources.csv_audit import concat_tables, read_audit_csv, write_validated
from cometa.sources.tables import table
from cometa.streaming.audit_stream import start_audit_stream, totals_of


def _layouts(spark, sf_dir) -> dict[str, DataFrame]:
    """The extract in two layouts; every seventh record has no date."""
    a = aud(spark, sf_dir).withColumn("Data", F.when(F.col("k") % 7 != 0, "2024-08-01"))
    k, nota, text, prior, date = (F.col(c) for c in ("k", "nota", "comentario", "analise_previa", "Data"))
    first = [k.alias("N. Serie"), nota.alias("Nota leit"), text.alias("Coment\nleitura"), prior.alias("Análise"), date]
    second = [date, prior.alias("Análise "), text.alias("Comentleitura"), F.lit("x").alias("Extra"), nota.alias(" Nota leit"), k.alias("N Serie")]
    return {"a layout": a.where(k % 2 == 0).select(*first), "b layout": a.where(k % 2 != 0).select(*second)}


def _extract(spark, sf_dir) -> str:
    folder = shared_path(spark, f"extract_{uuid.uuid4().hex}")
    for name, rows in _layouts(spark, sf_dir).items():
        write_validated(rows, f"{folder}/{name}", fmt="csv")
    return f"{folder}/*"


def csv_ingest(spark, sf_dir):
    """S1/S4 + P1 + P3 + P10: dated records of both layouts, columns by name."""
    df = read_audit_csv(spark, _extract(spark, sf_dir), date_required=True)
    return df.select(
        F.col("N_Serie").cast("long").alias("k"),
        F.col("Nota_leit").alias("nota"),
        F.col("Comentleitura").alias("comentario"),
        F.col("Análise").alias("analise_previa"),
        "Extra",
    )


def header_roles(spark, sf_dir):
    """P2a + P4: the columns by the roles that their headers give."""
    df, _ = standardize_analysis(read_audit_csv(spark, _extract(spark, sf_dir)))
    nota, comment, analysis = resolve_roles(df.columns)
    return df.select(F.col(nota).alias("nota"), F.col(comment).alias("comentario"), F.col(analysis).alias("analise"))


def label_decode(spark, sf_dir):
    """Class numbers back to names."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    classes = mp.class_table(d, "source")
    coded = mp.encode_labels(d, "source", classes, "idx").select("doc_id", "idx")
    return mp.decode_labels(coded, "idx", classes, "source").select("doc_id", F.col("idx").cast("int").alias("idx"), "source")


def fill_sentinel(spark, sf_dir):
    """Missing flags become -1."""
    return mp.fill_sentinel(docs(spark, sf_dir).select("doc_id", "quality", "toxic"), ["quality", "toxic"])


def concat_by_name(spark, sf_dir) -> DataFrame:
    """Customers and suppliers as one table; what one lacks is null."""
    c = table(spark, sf_dir, "customer").select("c_nationkey", F.col("c_custkey").alias("id"), "c_name")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), "s_name")
    return concat_tables([c, s])


def stream_totals(spark, sf_dir) -> DataFrame:
    """A1/A3/A5 on the stream: running totals per (note, label) in micro-batches of three
    files. The stream ends after the first layout and starts again when the second is there."""
    folder = shared_path(spark, f"stream_{uuid.uuid4().hex}")
    for name, rows in _layouts(spark, sf_dir).items():
        write_validated(rows, f"{folder}/in/{name}", fmt="csv")
        start_audit_stream(spark, f"{folder}/in/*", f"{folder}/out", files_per_batch=3).awaitTermination()
    return totals_of(spark, f"{folder}/out")


QUERIES = {
    "csv_ingest": csv_ingest,
    "header_roles": header_roles,
    "label_decode": label_decode,
    "fill_sentinel": fill_sentinel,
    "concat_by_name": concat_by_name,
    "stream_totals": stream_totals,
}

ORACLE = {
    "csv_ingest": f"""SELECT k, nota, NULLIF(comentario, '') AS comentario, analise_previa,
        CASE WHEN k % 2 <> 0 THEN 'x' END AS "Extra" FROM ({AUD_SQL}) WHERE k % 7 <> 0""",
    "header_roles": f"SELECT nota, NULLIF(comentario, '') AS comentario, analise_previa AS analise FROM ({AUD_SQL}) WHERE k % 7 <> 0",
    "stream_totals": AUDIT_CTES + "SELECT nota, analise, count(*) AS n FROM r WHERE k % 7 <> 0 GROUP BY nota, analise",
    "label_decode": "SELECT doc_id, CAST(dense_rank() OVER (ORDER BY source) - 1 AS INTEGER) AS idx, source FROM documents",
    "fill_sentinel": "SELECT d.doc_id, COALESCE(l.quality, -1) AS quality, COALESCE(l.toxic, -1) AS toxic "
    "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "concat_by_name": "SELECT c_nationkey, c_custkey AS id, c_name, NULL AS s_name FROM customer "
    "UNION ALL SELECT NULL, s_suppkey, NULL, s_name FROM supplier",
}
