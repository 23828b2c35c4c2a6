"""Spark-native evaluation of structured field extraction from documents."""
