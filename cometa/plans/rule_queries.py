"""The registered query of rules that come from a table (its SQL is beside the other audit oracles)."""

from __future__ import annotations

from cometa.operators.rules import RULES_SCHEMA
from cometa.operators.validate import with_table_rules
from cometa.plans.audit_queries import aud
from cometa.session import materialize

# Rules of a user's own: other notes, types and parameters than the fixed table's.
CUSTOM_RULES = [
    ("Z999", "FORMATO", "two numbers", None, None, r"^\d+ \d+$"),
    ("C111", "MEDIDOR_LEITURA", "a reading instead of a text", None, None, None),
    ("T171", "MEDIDOR_LEITURA_FUNCAO", "other functions", ["7", "55"], None, None),
    ("R161", "FORMATO", "a pole", None, None, r"^poste [mM]\d{6}$"),
    ("P131", "NOT A TYPE", "no validator", None, None, None),
]


def audit_custom_rules(spark, sf_dir):
    """V16 as data: the rules come from a written table and are evaluated by joined parameters."""
    rules = materialize(spark.createDataFrame(CUSTOM_RULES, RULES_SCHEMA), "custom_rules")
    return with_table_rules(aud(spark, sf_dir), "nota", "comentario", rules).select("k", "nota", "comentario", "analise")


QUERIES = {"audit_custom_rules": audit_custom_rules}
