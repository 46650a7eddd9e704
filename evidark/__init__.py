"""Spark-native engine for source-code evidence tables, routing experiments and their metrics."""
