"""Structured Streaming variants of the batch aggregations."""
