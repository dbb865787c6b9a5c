"""All registered queries and their oracle SQL."""

from __future__ import annotations


def all_queries():
    from cometa.plans import audit_queries, geo_queries, ingest_queries, ml_queries, model_queries, rule_queries

    out = {}
    out.update(audit_queries.QUERIES)
    out.update(rule_queries.QUERIES)
    out.update(ml_queries.QUERIES)
    out.update(geo_queries.QUERIES)
    out.update(model_queries.QUERIES)
    out.update(ingest_queries.QUERIES)
    return out


def all_oracle_sql():
    from cometa.plans import geo_queries, ingest_queries, model_queries, oracle_audit, oracle_ml

    out = {}
    out.update(oracle_audit.ORACLE)
    out.update(oracle_ml.ORACLE)
    out.update(geo_queries.ORACLE)
    out.update(ingest_queries.ORACLE)
    out.update(model_queries.oracles(oracle_audit.AUD_SQL))
    return out
