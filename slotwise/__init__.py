"""Spark-native time-series, event-study and forecast-evaluation operators."""
