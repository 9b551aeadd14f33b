"""Readers and writers for article, label, sentiment and prediction files."""
