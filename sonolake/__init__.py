"""Acoustic observation lakehouse, written as ordinary Spark DataFrame code."""
