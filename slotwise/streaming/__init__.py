"""Structured Streaming forms of refresh, version keeping and resampling."""
