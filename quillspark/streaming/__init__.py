"""Structured Streaming forms of operators that are naturally incremental."""
