"""Hybrid document search and incremental indexing on Spark."""
