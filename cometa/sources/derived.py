"""Audit-shaped tables derived from the driver's data.

The driver ships TPC-H-like tables, not meter-reading extracts. The audit
fixture is derived deterministically from ``lineitem`` (one audit record per
line item) so every audit query scales with the data: a narrow Project over
the scan, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Note assigned by l_orderkey mod 21 (index 20 = unknown note).
# ---------------------------------------------------------------------------
NOTE_BY_ORDER_MOD_21 = [
    "B111", "P111", "P131", "T171", "E101", "E111", "P231", "C111", "C121", "C131",
    "C151", "C161", "C181", "P191", "R161", "L131", "R111", "T161", "T181", "L121",
    "Z999",
]
# ---------------------------------------------------------------------------


def _s(c: Column) -> Column:
    return c.cast("string")


def _comment(tpl: Column, a: Column, b: Column) -> Column:
    """One of 22 comment templates: codes and readings in either case, accents,
    superscripts (digits that are no decimals) and free text."""
    templates = [
        F.concat(_s(a), F.lit(" "), _s(b)),
        _s(a),
        F.lit(""),
        F.concat(F.lit("M"), _s(a + 100000)),
        F.lit("SELO"),
        F.concat(F.lit("103 03"), _s(b)),
        F.concat(F.lit("03 "), _s(b)),
        F.concat(_s(a), F.lit("."), _s(b)),
        F.concat(_s(a), F.lit("   "), _s(b)),
        F.lit("cliente nao estava"),
        F.concat(_s(a), F.lit(" 1 2 3 4 5 6 7 8")),
        F.lit("01"),
        F.lit(None).cast("string"),
        F.concat(F.lit("MV0"), _s(a), F.lit(" NR DI")),
        F.concat(F.lit("S"), _s(b + 200000), F.lit(" T181 01 "), _s(a)),
        F.concat(F.lit("103"), _s(b)),
        F.concat(F.lit("poste m"), _s(a + 100000)),
        F.lit("não há ligação É"),
        F.concat(_s(a), F.lit(" ² ² ² ² ² ² ² ²")),
        F.concat(F.lit("t181 01 "), _s(b)),
        F.concat(F.lit("Ó "), _s(a), F.lit(" "), _s(b)),
    ]
    expr = None
    for i, t in enumerate(templates):
        expr = F.when(tpl == i, t) if expr is None else expr.when(tpl == i, t)
    return expr.otherwise(F.concat(F.lit("poste M"), _s(a + 100000)))


def derived_audit_table(lineitem: DataFrame) -> DataFrame:
    """``k, nota, comentario, analise_previa`` from ``lineitem``.

    ``k`` is not unique; compare results as multisets.
    """
    a = F.col("l_partkey")
    b = F.col("l_suppkey")
    tpl = (a * 31 + b * 7 + F.col("l_linenumber")) % 22
    notes = F.array(*[F.lit(n) for n in NOTE_BY_ORDER_MOD_21])
    nota = F.element_at(notes, (F.col("l_orderkey") % 21 + 1).cast("int"))
    # people also write labels that are not in the rules' alphabet
    prior = F.when((nota == "L121") & (b % 2 == 0), "C").when((nota == "L121") & (b % 3 == 0), "OK").when(a % 5 == 0, "NI")
    return lineitem.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"),
        nota.alias("nota"),
        _comment(tpl, a, b).alias("comentario"),
        prior.alias("analise_previa"),
    )


def labelled_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Text with a partly null label: ``documents LEFT JOIN labels``.

    ``label`` combines the two flags into four classes (``q<quality>t<toxic>``)
    and is null for documents without labels (the rows to predict).
    The labels table grows with the data, so the join is left to Spark
    (sort-merge, or broadcast when AQE sees a small side).
    """
    lab = labels.select(
        "doc_id",
        "quality",
        "toxic",
        F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("t"), F.col("toxic").cast("string")).alias("label"),
    )
    return documents.select("doc_id", "source", "lang", "text").join(lab, "doc_id", "left")


def route_points(customer: DataFrame) -> DataFrame:
    """Route stops derived from ``customer``: route = nation, stop order =
    customer key, coordinates spread deterministically around a city."""
    k = F.col("c_custkey")
    return customer.select(
        F.col("c_nationkey").cast("long").alias("route_id"),
        k.alias("seq"),
        (F.lit(-23.5) + ((k * 7919) % 10007).cast("double") / 100000.0).alias("lat"),
        (F.lit(-46.6) + ((k * 104729) % 10009).cast("double") / 100000.0).alias("lon"),
    )
