"""Spark-native LLM answer-quality analytics."""
