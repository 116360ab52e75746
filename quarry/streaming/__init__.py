"""Incremental indexing and progress."""
