"""Spark-native data quality, entity resolution and linking engine."""
