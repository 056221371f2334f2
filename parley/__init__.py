"""Spark-native preparation and analysis of conversational and preference corpora."""
