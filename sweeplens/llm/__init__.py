"""Operators for training-data pipelines: scoring, deduplication, mixing, packing, search."""
