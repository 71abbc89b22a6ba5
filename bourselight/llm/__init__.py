"""Operators of a training-data pipeline: scoring, packing, deduplication, tokens, quality, web records, personal data."""
