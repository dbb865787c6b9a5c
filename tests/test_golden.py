"""Golden cases: the published rule examples and hand-traced edge cases."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cometa.fixtures import EDGE_CASES, GOLDEN_CASES, PROSE_CASES
from cometa.operators.validate import audit_label

SCHEMA = T.StructType(
    [
        T.StructField("i", T.IntegerType()),
        T.StructField("nota", T.StringType()),
        T.StructField("comentario", T.StringType()),
        T.StructField("expected", T.StringType()),
    ]
)


def _run(spark, cases):
    rows = [(i, n, c, e) for i, (n, c, e) in enumerate(cases)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = df.withColumn("got", audit_label("nota", "comentario")).orderBy("i").collect()
    return [(r.nota, r.comentario, r.expected, r.got) for r in out]


@pytest.mark.parametrize("cases", [GOLDEN_CASES, PROSE_CASES, EDGE_CASES], ids=["golden", "prose", "edge"])
def test_cases(spark, cases):
    bad = [r for r in _run(spark, cases) if r[2] != r[3]]
    assert not bad, bad


def test_golden_count():
    assert len(GOLDEN_CASES) == 31


def test_no_python_in_audit_plan(spark):
    df = spark.createDataFrame([("B111", "1")], "nota string, comentario string")
    plan = df.select(audit_label("nota", "comentario").alias("a"))._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


@pytest.mark.parametrize("cases", [GOLDEN_CASES, PROSE_CASES, EDGE_CASES], ids=["golden", "prose", "edge"])
def test_cases_staged(spark, cases):
    from cometa.operators.validate import with_audit_label

    rows = [(i, n, c, e) for i, (n, c, e) in enumerate(cases)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = with_audit_label(df, "nota", "comentario", "got").orderBy("i").collect()
    bad = [(r.nota, r.comentario, r.expected, r.got) for r in out if r.expected != r.got]
    assert not bad, bad
    assert out[0].asDict().keys() == {"i", "nota", "comentario", "expected", "got"}
