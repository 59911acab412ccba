"""Operators of a training-data pipeline: thirteen DataFrame operators and their queries."""
