"""Spark-native preparation and assessment of multilingual speech corpora."""
