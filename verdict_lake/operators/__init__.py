"""Operators over the benchmark tables."""
