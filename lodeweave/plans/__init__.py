"""Registered queries: each module has ``QUERIES`` and, where SQL can say the same, ``SQL``."""
