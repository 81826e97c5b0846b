"""Operators for training-data pipelines: screening, deduplication, mixing and packing of documents."""
