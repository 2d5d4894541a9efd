"""Operators of a training-data pipeline: filters, near duplicates, classifiers, search and tokens."""
