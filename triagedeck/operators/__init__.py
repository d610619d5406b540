"""Relational operators: labels, dedup, splits, joins, metrics, features, models."""
