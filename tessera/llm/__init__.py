"""Operators for training-data pipelines: filters, deduplication, mixing and packing."""
