"""Structured Streaming: the audit on files as they arrive."""
