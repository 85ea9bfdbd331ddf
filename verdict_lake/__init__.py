"""Spark jobs for building and scoring model-evaluation benchmarks."""
