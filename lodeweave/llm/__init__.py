"""Operators on text and code for preparing training data. Nothing outside this package imports it."""
