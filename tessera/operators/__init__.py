"""Operators: statistics, split, preprocessing, models, metrics, profile."""
