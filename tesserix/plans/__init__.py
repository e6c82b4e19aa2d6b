"""Registered queries: what to run on the given tables, and the same question as plain SQL."""
