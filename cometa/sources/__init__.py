"""Scans and sinks: parquet tables, delimited audit extracts, derived tables."""
