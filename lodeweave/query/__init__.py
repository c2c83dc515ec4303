"""Guarded read-only queries: SQL over the graph's views, and a subset of the pattern language."""
