"""Spark-native profiling and scoring of text-to-SQL corpora."""
