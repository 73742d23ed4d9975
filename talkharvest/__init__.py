"""Spark-first analytics for multilingual visitor feedback."""
