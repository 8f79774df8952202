"""Meridian: a Spark-native engine for signal research and data preparation."""
