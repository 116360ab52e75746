"""Readers, extractors and model seams."""
