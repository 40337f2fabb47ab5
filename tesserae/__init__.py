"""Spark-native analytics over measurement tables, evidence graphs and text corpora."""
