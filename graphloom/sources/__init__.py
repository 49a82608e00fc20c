"""Readers: parquet tables, source trees, JSON lines."""
