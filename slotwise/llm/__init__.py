"""Operators of a training-data pipeline: quality, toxicity, packing, deduplication, filtering, decontamination."""
