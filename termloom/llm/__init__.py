"""Operators of a training-data pipeline: search, extraction, encoding, deduplication, scoring and mixing of documents."""
