"""Whole pipelines, and the queries that run them over the test tables."""
