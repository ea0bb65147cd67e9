"""Spark-native engine for matching line items against a product catalogue."""
