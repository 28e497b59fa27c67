"""Operators for preparing document collections as training data, run on Spark."""
