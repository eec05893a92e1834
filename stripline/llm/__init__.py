"""Operators for training-data pipelines; ``queries`` registers one query for each."""
