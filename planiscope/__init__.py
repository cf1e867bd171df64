"""Spark-native decision-boundary, half-space and rule analytics."""
