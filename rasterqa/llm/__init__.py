"""Operators for training-data pipelines over document, label and vector tables."""
