"""Structured Streaming entry points for the same normalize + detect operators."""
