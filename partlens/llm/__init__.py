"""Operators of a training-data pipeline: mixing, quality, extraction, tokens, near-duplicates, suffixes, URLs, scoring."""
