"""Readers for page content, corpora and datasets."""
