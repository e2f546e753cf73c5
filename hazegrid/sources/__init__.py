"""Readers, writers, schemas and the views built on the given tables."""
