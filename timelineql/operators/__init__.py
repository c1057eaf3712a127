"""Operators beyond the query language: batches, pattern strings, incidence."""
