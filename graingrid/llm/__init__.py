"""Operators for training-data corpora: ten methods, their queries and SQL."""
