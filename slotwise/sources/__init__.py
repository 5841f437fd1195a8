"""Readers, writers, source normalization and refresh."""
