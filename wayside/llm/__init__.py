"""Operators for training-data pipelines: fingerprints, deduplication, filters, models, mixing, token output."""
