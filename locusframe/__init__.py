"""Spark-native analytics for pathogen population genomics."""
