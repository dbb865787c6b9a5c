"""Rules as data, and validators of a user's own."""

import pytest
from pyspark.sql import functions as F

from cometa.operators import rules as r
from cometa.operators import validate as v
from cometa.plans.audit_queries import aud
from tests.conftest import SF001


def labels(df):
    return sorted((x.nota or "", x.comentario or "", x.analise or "") for x in df.select("nota", "comentario", "analise").collect())


def test_the_fixed_rules_as_a_table_label_alike(spark):
    a = aud(spark, SF001).withColumn("nota", F.when(F.col("k") % 13 == 0, F.lit(None)).when(F.col("k") % 5 == 0, F.concat(F.lit(" "), "nota")).otherwise(F.col("nota")))
    assert labels(v.with_table_rules(a, "nota", "comentario", r.rules_frame(spark))) == labels(v.with_audit_label(a, "nota", "comentario"))


def test_a_row_reads_its_own_rules_parameters(spark):
    rules = spark.createDataFrame(
        [("A1", "MEDIDOR_LEITURA_FUNCAO", "", ["77"], None, None), ("A2", "MEDIDOR_LEITURA_FUNCAO", "", ["88", "99"], None, None), ("A3", "MEDIDOR_LEITURA_FUNCAO", "", None, None, None),
         ("A4", "FORMATO", "", None, None, "^ab+$"), ("A5", "FORMATO", "", None, None, None)],
        r.RULES_SCHEMA,
    )
    rows = [("A1", "77 1034567 1", "C"), ("A1", "88 1034567 1", "NI"), ("A2", "88 1034567 1", "C"), ("A2", "77 5", "NI"), ("A3", "77 5", "NI"),
            ("A4", "abbb", "C"), ("A4", "abc", "CFP"), ("A5", "abbb", "CFP"), ("B1", "abc", "C"), (None, "abc", "C"), ("A4", "", "SC"), ("A4", None, "SC"), ("L121", "x", None)]
    df = spark.createDataFrame(rows, "nota string, comentario string, want string")
    got = v.with_table_rules(df, "nota", "comentario", rules).collect()
    assert [(x.nota, x.comentario, x.analise) for x in got if x.analise != x.want] == []
    assert set(v.with_table_rules(df, "nota", "comentario", rules).columns) == {"nota", "comentario", "want", "analise"}
    assert len(v.with_table_rules(df, "nota", "comentario", rules.limit(0)).collect()) == len(rows)
    assert v.with_table_rules(df.limit(0), "nota", "comentario", rules).collect() == []


def test_two_rules_for_a_note_end_the_job(spark):
    rules = spark.createDataFrame([("A1", "CAMPANHA", "", None, None, None), (" A1 ", "FORMATO", "", None, None, None)], r.RULES_SCHEMA)
    df = spark.createDataFrame([("A1", "x")], "nota string, comentario string")
    with pytest.raises(Exception, match="two rules for note A1"):
        v.with_table_rules(df, "nota", "comentario", rules).collect()


def test_a_validator_of_ones_own(spark, monkeypatch):
    monkeypatch.setattr(v, "VALIDATORS", dict(v.VALIDATORS))
    monkeypatch.setattr(v, "_USES_FEATS", set(v._USES_FEATS))
    v.register_validator("EVEN_RUNS", lambda f, rule: F.when(f.runs % 2 == 0, "C").otherwise("NI"))
    v.register_validator("SHORT", lambda f, rule: F.when(F.length(f.c) < 4, "C").otherwise("CI"), uses_features=False)
    listed = [r.Rule("N1", "EVEN_RUNS", ""), r.Rule("N2", "SHORT", "")]
    df = spark.createDataFrame([("N1", "1 2"), ("N1", "1 2 3"), ("N2", "abc"), ("N2", "abcd"), ("N3", "x")], "nota string, comentario string")
    want = ["C", "NI", "C", "CI", "C"]
    assert [x.analise for x in v.with_audit_label(df, "nota", "comentario", rules=listed).collect()] == want
    assert [x.analise for x in v.with_table_rules(df, "nota", "comentario", r.rules_frame(spark, listed)).collect()] == want
    assert [x.a for x in df.select(v.audit_label("nota", "comentario", listed).alias("a")).collect()] == want


def test_the_plan_does_not_grow_with_the_rules(spark):
    df = aud(spark, SF001)
    few, many = ([(f"N{k}", "MEDIDOR_LEITURA_FUNCAO", "", [str(k)], None, None) for k in range(n)] for n in (3, 500))
    plans = [v.with_table_rules(df, "nota", "comentario", spark.createDataFrame(x, r.RULES_SCHEMA))._jdf.queryExecution().optimizedPlan().toString() for x in (few, many)]
    assert abs(len(plans[0]) - len(plans[1])) < 50 and "Expand" not in plans[0]
