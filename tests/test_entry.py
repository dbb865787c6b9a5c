"""Driver contract: entry runs, every query has an oracle (models and corpus operators excepted),
and every SQL-checkable query equals its DuckDB oracle on sf0.001."""

import pytest

import __spark_entry__ as e
from tests.conftest import SF001
from tools.oracle_check import compare, open_duckdb

MODEL_QUERIES = {"rf_predict", "text_predict", "text_report", "text_history", "embedding_predict", "two_stage_infer", "word_neighbours"}


def test_entry(spark):
    df = e.entry(spark)
    rows = df.collect()
    assert rows and df.columns == ["analise", "n"]


def test_every_query_has_oracle():
    corpus = set(e._corpus()[0])
    missing = set(e.queries()) - set(e.oracle_sql()) - corpus
    assert missing == MODEL_QUERIES
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.fixture(scope="module")
def con():
    return open_duckdb(SF001)


@pytest.mark.parametrize("name", sorted(set(e.oracle_sql())))
def test_oracle(spark, con, name):
    ok, msg = compare(e.queries()[name](spark, SF001), con, e.oracle_sql()[name])
    assert ok, msg
