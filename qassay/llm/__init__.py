"""Operators for training-data pipelines: scoring, counting, deduplication, packing, decontamination, pseudonyms."""
