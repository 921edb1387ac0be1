"""Spark-native graph partitioning, diagram analytics and relation accounting."""
