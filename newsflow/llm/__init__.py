"""Operators for training-data pipelines, each with its query over the supplied tables."""
