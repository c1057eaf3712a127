"""Queries over streams of events."""
