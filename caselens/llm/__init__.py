"""Operators of a training-data pipeline: extraction, language, quality, duplicates, contamination, tokens."""
