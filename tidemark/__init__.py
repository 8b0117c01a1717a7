"""Tidemark: longitudinal text and event measurement on PySpark."""
