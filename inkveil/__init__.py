"""Sensitive-text detection as a Spark dataflow."""
