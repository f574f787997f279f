"""Operators for training-data pipelines: deduplication, search, tokens, packing, sharding, archives, filters."""
