"""Operators of a training-data pipeline (deduplication, quality, privacy, extraction, tokens).

Nothing else in the library imports this subpackage.
"""
