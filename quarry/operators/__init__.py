"""Relational operators of search and indexing."""
